"""Word lists and patterns of the document checks."""

# Task marks in test order.
TASK_MARKS = ["🆕", "🔄", "♻️", "🗑️", "🔗", "新增", "优化", "复用", "删除", "对接"]
# Dependency lines, first match wins.
DEPENDENCY = [r"\*\*依赖\*\*:\s*([^\n]+)", r"依赖 [：:]\s*([^\n]+)", r"前置 [任务 | 条件]:\s*([^\n]+)"]
# Words of the four parts of an interface definition.
API_PARTS = {
    "url": ["URL", "url", "接口地址", "HTTP"],
    "params": ["请求参数", "参数", "入参"],
    "response": ["返回", "响应", "出参"],
    "error_codes": ["错误码", "错误", "errorCode"],
}
# File paths that make an implementation note concrete, and method marks.
PATHS = [
    r"src/main/java/[^\n]+\.java",
    r"src/main/resources/[^\n]+\.xml",
    r"src/test/java/[^\n]+\.java",
    r"[a-zA-Z0-9_-]+/[^:\n]+\.java",
    r"[a-zA-Z0-9_-]+/[^:\n]+\.py",
    r"[a-zA-Z0-9_-]+/[^:\n]+\.xml",
    r"Controller\.java",
    r"Service\.java",
    r"Mapper\.xml",
]
METHODS = ["方法", "method", "()", "(@"]
# Acceptance headings and list items.
ACCEPTANCE = ["验收标准", "验收条件", "Acceptance Criteria", "测试用例"]
CHECKLIST = [r"\[ \]", r"^\s*[-*]\s+", r"^\s*\d+\.\s+"]
# Effort and priority, first match wins.
EFFORT = [r"\*\*工作量\*\*:\s*([^\n]+)", r"工作量 [：:]\s*([^\n]+)", r"(\d+\.?\d*)\s*[人天|天|小时]"]
PRIORITY = [r"\*\*优先级\*\*:\s*(P[0-2])", r"优先级 [：:]\s*(P[0-2])", r"(P[0-2])"]
BACKGROUND = ["业务背景", "需求背景", "背景介绍", "Background", "使用场景"]
# Weights, pass mark and grades.
REQUIRED_WEIGHT, BONUS_WEIGHT, PASS_MARK = 14, 10, 70
LEVELS = [(90, "优秀"), (80, "良好"), (70, "合格"), (60, "需改进"), (0, "不合格")]
REQUIRED = ["task_type", "dependencies", "api_definition", "implementation", "acceptance_criteria"]
BONUS = ["effort", "priority", "background"]
# Metadata lines.
VERSION = r"\*\*版本\*\*:\s*([^\n]+)"
CREATED = r"\*\*创建时间\*\*:\s*([^\n]+)"
STACKS = [("java", ["java", "spring"]), ("python", ["python", "fastapi"])]

# Vague phrases are fixed values; the hints are our own wording.
VAGUE = [
    ("优化一下", "say what is added and the time before and after"),
    ("改一下", "name the file and the method"),
    ("弄一下", "name the function to build"),
    ("搞一下", "name the interface to build"),
    ("看一下", "name the condition to check"),
    ("查一下", "name the table and the condition"),
    ("大概", "give a number"),
    ("左右", "give a range"),
    ("差不多", "give an exact value"),
    ("基本", "give a share"),
    ("几乎", "give a share"),
    ("很快", "give a time limit"),
    ("立即", "give a time limit"),
    ("稍后", "give a time"),
    ("过一会", "give a time"),
    ("大量", "give a count or a rate"),
    ("很多", "give a number"),
    ("少量", "give an upper bound"),
    ("一些", "give a number"),
    ("几个", "give a number"),
    ("偶尔", "give a rate"),
    ("有时", "give a share"),
    ("经常", "give a share"),
    ("通常", "give a share"),
    ("良好", "give a measure"),
    ("优秀", "give a measure"),
    ("较好", "say compared with what"),
    ("可以", "state a conclusion"),
    ("还行", "state a conclusion"),
    ("考虑扩展性", "name the fields kept free and the case they serve"),
    ("处理异常", "name the exception and the error code"),
    ("性能优化", "give both times and the means"),
    ("支持多种", "give the count and list them"),
    ("等等", "list all of them"),
    ("相关", "name the items"),
]
VAGUE_JAVA = [
    ("新建一个 Controller", "give the class and its path"),
    ("新建一个 Service", "give the class and its path"),
    ("新建一个 Mapper", "give the file and its path"),
    ("加个方法", "give the signature"),
    ("改个字段", "give the field, its type and meaning"),
]
SUGGESTIONS = {
    "task_type": "add a task mark",
    "dependencies": "state the dependencies",
    "api_definition": "add URL, parameters, response and error codes",
    "implementation": "add file paths and methods",
    "acceptance_criteria": "add a checklist that can be run",
    "effort": "add the effort",
    "priority": "add a priority P0 to P2",
    "background": "add the business background",
}

# Look-alike radicals of extracted text and the characters they stand for.
RADICALS = "⼿⽤⼾⼆⼭⼝⼥⼦⽂⽅⽆⽇⽉⽊⽔⽕⼟⾦⽽⼏⽬⽴⽵⽶⻔⻋⾛⾜⾁⾷⾔⻆⻣⾼⼀⼈⼊⼒⼤⼩⼯⼰⼴⼼⽀⽌⽐⽚⽣⽰⽹⾃⾄⾏⾮⾯⾸⻚⻓⻄⻨⻩"
CHARACTERS = "手用户二山口女子文方无日月木水火土金而几目立竹米门车走足肉食言角骨高一人入力大小工己广心支止比片生示网自至行非面首页长西麦黄"
# Words whose doubling is an extraction fault.
DOUBLED = ["列表", "管理", "功能", "配置", "接口", "任务", "开发", "逻辑", "技能", "模块", "查询", "删除", "安装", "搜索"]
METHOD_NAMES = ["POST", "GET", "PUT", "DELETE", "PATCH"]
