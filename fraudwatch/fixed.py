"""Fixed values of the domain.

These are label names, thresholds, text formats and markers that a result must
carry literally.  They are data, kept in one place; no logic lives here.
"""

# Decision threshold shared by every ensemble member.
FRAUD_THRESHOLD = 0.85

# Class domain: 0 is normal, 1..4 are the scam classes.
NORMAL = "正常"
SCAM_TYPES = ["公检法诈骗", "贷款诈骗", "客服诈骗", "熟人诈骗"]
CLASS_NAMES = [NORMAL] + SCAM_TYPES
OTHER_SCAM = "其它诈骗"

# Stand-ins for a missing fraud type: counters, screens, generated answers.
UNKNOWN_TYPE = "未知诈骗"
SUSPECTED_TYPE = "疑似诈骗"
SCAM_WORD = "诈骗"

# Default of the strongest-model lookup.
NO_MODEL = "AI检测"

# Placeholders for blank training fields.
NO_CONTENT = "无内容"
NO_LABEL = "无标签"

# Cost of misjudging a normal message against a scam.
NORMAL_WEIGHT = 5.0
SCAM_WEIGHT = 1.0

# Feature sizes.
MAX_TERMS = 15000
CNN_LENGTH = 120
MASKED_LENGTH = 128
CHAT_LENGTH = 256
PAD_ID = 0
UNK_ID = 1

# Report status of a stopped message.
INTERCEPTED = "intercepted"

# Polling interval in seconds.
POLL_SECONDS = 300

# Ordered rules for canonical scam types: the first word found wins.
CANONICAL_RULES = [
    ("公检法", "公检法诈骗"),
    ("政府机关", "公检法诈骗"),
    ("贷款", "贷款诈骗"),
    ("客服", "客服诈骗"),
    ("熟人", "熟人诈骗"),
    ("领导", "熟人诈骗"),
    (NORMAL, NORMAL),
]

# Cell texts that a CSV reader treats as missing (the pandas default list).
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Every character Python's str.isspace() and \s accept, as text and as a regex class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# Archive record written by the report generator.
ARCHIVE_FIELDS = [
    "intercept_time", "user_mailbox", "raw_content_summary", "fraud_type",
    "confidence_avg", "user_alert_content", "similar_cases_suggest",
]

# Markers that delimit the two parts of a generated reply.
ALERT_MARKER = "### [用户告警邮件内容]"
ARCHIVE_MARKER = "### [系统存档 JSON 报告]"
FENCE_OPEN = "```json"
FENCE_CLOSE = "```"
REPLY_UNAVAILABLE = "分析服务暂时不可用，请手动核查。"
BAD_JSON = "invalid json"
ANSWER_ROLE = "assistant"

# Screen default for the advice field.
DEFAULT_ADVICE = "请勿点击任何链接，不要回复邮件。如有资金往来，请立即报警。"

# Instruction text handed to the report generator; %s slots in order: mailbox,
# sender, subject, body, intercept time, detection JSON, send date.
PROMPT_FORMAT = """
你是一个专业的反诈系统分析专家。
系统刚刚拦截了一封疑似诈骗邮件，信息如下：
- 用户邮箱: %s
- 发件人: %s
- 邮件主题: %s
- 邮件正文: %s
- 拦截时间: %s

小模型检测结果（OR逻辑已触发拦截）：
%s

请根据以上信息，输出两部分内容。

### [用户告警邮件内容]
- 包含：拦截时间、发送时间（%s）、可能诈骗内容摘要。
- 重点：以通俗易懂的方式向用户解释“为什么这是诈骗”（结合小模型的类型判定，如贷款诈骗、冒充公检法等）。

### [系统存档 JSON 报告]
请按以下 JSON 结构输出系统报告：
{
  "intercept_time": "...",
  "user_mailbox": "...",
  "raw_content_summary": "...",
  "fraud_type": "...",
  "confidence_avg": "...",
  "user_alert_content": "...",
  "similar_cases_suggest": "..."
}

注意：请直接输出内容，JSON 部分要包含在对应的 markdown 代码块中。
"""
