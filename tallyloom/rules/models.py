"""Model prices, sizes and encodings, and the channel lists.

Each list is ordered: look-ups take an exact name first and otherwise the first
entry contained in the name.
"""

# Model, USD per million input tokens, USD per million output tokens.
PRICES = [
    ("deepseek-v4-flash", 0.15, 0.60),
    ("deepseek-chat", 0.14, 0.28),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("claude-3.5-sonnet", 3.00, 15.00),
    ("glm-4", 0.50, 2.00),
]

# Model, context window, largest output.
SPECS = [
    ("deepseek-v4-flash", 1_000_000, 65_536),
    ("deepseek-chat", 65_536, 8_192),
    ("deepseek-reasoner", 65_536, 8_192),
    ("qwen3.5-plus", 1_000_000, 65_536),
    ("qwen3-max-2025-09-23", 32_768, 8_192),
    ("gpt-4o", 128_000, 16_384),
    ("gpt-4o-mini", 128_000, 16_384),
    ("claude-3.5-sonnet", 200_000, 8_192),
    ("glm-4", 128_000, 4_096),
]
DEFAULT_SPEC = (128_000, 8_192)

# Model name part, tokenizer encoding.
ENCODINGS = [
    ("deepseek-v4-flash", "cl100k_base"),
    ("deepseek-v4-pro", "cl100k_base"),
    ("deepseek-chat", "cl100k_base"),
    ("deepseek-reasoner", "cl100k_base"),
    ("gpt-4o", "o200k_base"),
    ("claude-3", "cl100k_base"),
    ("claude-3.5", "cl100k_base"),
    ("claude-4", "cl100k_base"),
    ("claude-opus", "cl100k_base"),
    ("claude-sonnet", "cl100k_base"),
    ("claude-haiku", "cl100k_base"),
    ("glm-4", "o200k_base"),
    ("glm-4v", "o200k_base"),
    ("glm-3", "cl100k_base"),
    ("gpt-4", "cl100k_base"),
    ("gpt-3.5", "cl100k_base"),
    ("deepseek", "cl100k_base"),
]
DEFAULT_ENCODING = "cl100k_base"

# Listening port, channel.
PORT_CHANNELS = [(8090, "default")]

# User-agent pattern (any case), channel. Put the pattern of an own client in front.
AGENT_CHANNELS = [
    (r"openai[-/]python", "Python"),
    (r"python-requests|python-urllib", "Python"),
    (r"curl[/\s]", "curl"),
    (r"langchain", "LangChain"),
    (r"litellm", "LiteLLM"),
    (r"Apache-HttpClient|OkHttp|Java", "Java"),
    (r"Go-http-client", "Go"),
    (r"node-fetch|axios|undici", "Node.js"),
    (r"Continue", "Continue"),
    (r"LobeChat|ChatGPT-Next-Web", "ChatUI"),
    (r"Cursor|Windsurf", "IDE"),
    (r"vscode", "VSCode"),
]

# Third part of a source id, display name.
SOURCE_CHANNELS = [
    ("feishu", "飞书"),
    ("telegram", "Telegram"),
    ("discord", "Discord"),
    ("main", "主会话"),
    ("subagent", "子智能体"),
    ("openresponses", "API 调用"),
]
OTHER_CHANNEL = "其他"
