"""Scores and factors of the effort estimate."""

# Name, score, groups of words (one word of every group must occur), words that rule the entry out.
ENTITIES = [
    ("多表设计", 1.0, [["多表", "多张表", "复数表"]], []),
    ("单表设计", 0.5, "table", ["多表", "批量表", "全部表"]),
    ("标准接口", 2.0, [["新增", "创建", "新建"], ["接口", "api"]], []),
    ("简单接口", 1.0, [["查询", "列表", "删除", "详情", "导出", "查看"], ["接口", "api"]], "标准接口"),
    ("页面/UI", 2.0, [["页面", "页面功能", "界面"]], []),
    ("配置/设置", 0.5, [["配置", "环境变量", "参数设置"]], []),
    ("数据迁移", 2.5, [["数据迁移", "数据清洗", "历史数据"]], []),
    ("定时任务", 1.5, [["定时", "调度", "xxl-job", "cron", "定时任务"]], []),
    ("中间件/缓存", 1.5, [["redis", "mq", "kafka", "消息队列", "缓存"]], []),
    ("工作流/审批", 2.0, [["工作流", "审批", "审核流程"]], []),
]
# Name, score, words.
SPECIALS = [
    ("分布式/高并发", 1.5, ["分布式", "高并发"]),
    ("事务/补偿", 1.0, ["事务", "补偿", "一致性"]),
    ("第三方集成", 1.5, ["集成", "对接", "第三方"]),
    ("批量操作", 1.0, ["批量"]),
    ("权限/安全", 0.5, ["权限", "安全", "鉴权"]),
]
# Fixed value: "表" as a table, not as part of list, chart, report, agent or form words.
TABLE_WORD = r"(?:\A|[^列图报代发外表])表|表表(?:[^格]|\z)"
# Days per type without any feature.
FALLBACK = {
    "接口任务": 1.5,
    "数据库任务": 0.5,
    "前端任务": 2.0,
    "配置任务": 0.3,
    "中间件任务": 1.5,
    "运维任务": 1.0,
    "架构设计": 2.0,
    "数据迁移": 2.5,
    "权限/安全": 1.5,
    "功能任务": 2.0,
}
FALLBACK_DEFAULT = 1.5
# Factor and words, first group found wins.
ITERATION = [
    (1.0, ["新增", "新建", "创建", "create", "设计"]),
    (0.5, ["修改", "优化", "改造", "重构", "升级", "改进"]),
    (0.3, ["删除", "废弃", "下线", "移除"]),
]
SMALLEST, LARGEST = 0.3, 20
# Least records and spread.
PRECISION = [(20, 0.15), (6, 0.20), (3, 0.30), (0, 0.50)]
MIN_RECORDS = 3
# Days of a planned task by words, first group found wins.
PLAN_EFFORT = [
    (5.0, ["design", "架构", "设计", "database", "数据库"]),
    (3.0, ["api", "interface", "接口", "endpoint"]),
    (2.0, ["test", "测试", "qa", "validation"]),
    (1.0, ["document", "文档", "readme"]),
]
PLAN_DEFAULT, PLAN_PER_DEPENDENCY = 2.0, 0.5
TEST_WORDS = ["test", "测试", "qa"]
# Name, back-end people, test people.
STAFFING = [("精简版", 2, 1), ("标准版", 3, 1), ("加速版", 4, 2)]
