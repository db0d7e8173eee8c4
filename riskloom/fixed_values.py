"""Fixed values.

Thresholds, labels and word lists that have to be exactly these for results to
agree with existing deployments.  They are data, kept in one place.
"""

# --- amounts -----------------------------------------------------------------
MIN_AMOUNT = "0.01"
MAX_AMOUNT = "10000000.00"
DEFAULT_CURRENCY = "CNY"

# --- address classes ---------------------------------------------------------
HIGH_RISK_IP_PREFIXES = ("185.220.", "23.129.")
MEDIUM_RISK_IP_PREFIXES = ("103.", "45.")
IPV4_OR_EMPTY = r"^$|^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"

# --- countries and industries ------------------------------------------------
FATF_COUNTRIES = ("KP", "IR", "SY", "MM", "YE", "LY", "SO", "CU", "VE")
WAR_COUNTRIES = ("SY", "YE", "LY", "SO")
RISKY_INDUSTRIES = ("VIRTUAL_CURRENCY", "NPO", "GAMBLING")
ANONYMOUS_IP_LEVELS = ("VPN", "PROXY", "TOR", "HIGH_RISK")

# --- compliance --------------------------------------------------------------
LARGE_AMOUNT = 50000
LARGE_AMOUNT_HIGH = 100000
CROSS_BORDER_AMOUNT = 10000
CROSS_BORDER_HIGH = 50000
REASON_LARGE = "大额交易: "
REASON_SPLIT_TOTAL = "拆分交易: 日总额="
REASON_SPLIT_COUNT = ", 笔数="
REASON_CROSS_BORDER = "跨境交易: "

# --- customer score: (exclusive lower bound, points), highest first -----------
SCORE_FREQUENCY = ((50, 40.0), (20, 25.0), (10, 10.0))
SCORE_SIZE = ((50000, 35.0), (20000, 20.0), (10000, 10.0))
SCORE_DISPERSION = ((20, 30.0), (10, 20.0), (5, 10.0))
SCORE_VOLATILITY = ((2.0, 20.0),)
SCORE_HISTORY = (("HIGH", 30.0), ("MEDIUM", 15.0))
# (inclusive lower bound, level)
RULE_LEVELS = ("LOW", "MEDIUM", "HIGH")
CUSTOMER_LEVELS = ((70, "CRITICAL"), (50, "HIGH"), (30, "MEDIUM"))

# --- transaction score -------------------------------------------------------
RULE_WEIGHT = 0.4
MODEL_WEIGHT = 0.6
HIGH_SCORE = 80
MEDIUM_SCORE = 50
MODEL_BLOCK_SCORE = 85
BLOCKING_RULE_WEIGHT = 90
SANCTION_RULE = "T001"
RULE_SCORE_FACTOR = 1.5
FALLBACK_PROBABILITY = 0.5
SANCTION_DETAIL = "交易对手命中制裁名单"

# --- risk factor texts -------------------------------------------------------
FACTOR_NEW_DEVICE = "新设备首次交易"
FACTOR_NIGHT = "夜间交易"
FACTOR_CROSS_BORDER = "跨境交易"
FACTOR_MODEL = "ML模型判定高风险 (得分≥80)"

# --- model features ----------------------------------------------------------
CHANNELS = ("EBANK", "MBANK", "COUNTER", "ATM", "POS")
TRANSACTION_TYPES = ("TRANSFER", "PAYMENT", "WITHDRAW", "DEPOSIT")
IP_LEVEL_CODES = (("HIGH_RISK", 0.9), ("MEDIUM_RISK", 0.5), ("LOW_RISK", 0.2))
AMOUNT_BINS = (10000, 100000, 500000)
FEATURE_IMPORTANCE = (
    ("交易金额", 0.15),
    ("1h交易频率", 0.12),
    ("24h交易频率", 0.10),
    ("30天设备数", 0.08),
    ("30天城市数", 0.07),
    ("30天对手数", 0.06),
    ("夜间交易", 0.05),
    ("跨境交易", 0.08),
    ("新设备", 0.07),
    ("IP风险等级", 0.06),
    ("金额偏离度", 0.05),
    ("模拟器检测", 0.06),
    ("ROOT检测", 0.05),
)

# --- similar-case texts ------------------------------------------------------
CASE_TEXT_LABELS = ("案例标题", "案例类型", "欺诈模式", "作案手法", "案例描述", "处置方案")
TEXT_UNKNOWN = "未知"
TEXT_NONE = "暂无"
TRANSACTION_TEXT_LABELS = (
    "交易金额", "交易类型", "渠道", "时间", "1小时交易次数", "24小时交易次数",
    "是否新设备", "是否跨境", "IP风险", "30天设备数", "30天城市数", "金额偏离度",
)
CONTEXT_HEADER = "## 相似历史案例 (RAG检索结果)\n"
CONTEXT_LABELS = ("类型", "模式", "手法", "处置", "效果")
CASE_DESCRIPTION_LENGTH = 500

# --- alerts and cases --------------------------------------------------------
ALERT_DEADLINE_HOURS = (("HIGH", 24), ("MEDIUM", 72))
ALERT_DEADLINE_DEFAULT_HOURS = 168
CASE_PRIORITY = (("CRITICAL", 1), ("HIGH", 2), ("MEDIUM", 3))
CASE_PRIORITY_DEFAULT = 4

# --- alert and case states by action -------------------------------------------
ALERT_STATES = (("CREATE", "NEW"), ("PROCESSING", "PROCESSING"), ("RESOLVED", "RESOLVED"), ("ESCALATE", "PENDING"))
CASE_STATES = (("CREATE", "NEW"), ("ASSIGN", "ASSIGNED"), ("PROCESS", "INVESTIGATING"), ("CLOSE", "CLOSED"))

# --- stored columns ------------------------------------------------------------
FEATURE_COLUMNS = (
    "customer_id_hash", "total_amount_30d", "avg_amount_30d", "max_amount_30d", "std_amount_30d",
    "total_count_30d", "avg_daily_count_30d", "night_count_30d", "weekend_count_30d",
    "channel_diversity_30d", "merchant_diversity_30d", "amount_deviation_ratio",
    "frequency_deviation_ratio", "feature_version", "computed_at",
)

ANALYTIC_COLUMNS = (
    "transaction_id", "account_id_hash", "amount", "amount_1h", "count_1h", "amount_24h", "count_24h",
    "device_count_30d", "city_count_30d", "is_night_time", "is_cross_border", "is_first_device",
    "ip_risk_level", "amount_deviation",
)
STORE_FEATURES = (
    "amount_1h", "count_1h", "amount_24h", "count_24h", "device_count_30d", "city_count_30d",
    "counterparty_count_30d", "is_night_time", "is_cross_border", "is_first_device", "ip_risk_level",
    "amount_deviation",
)

# --- request defaults ----------------------------------------------------------
DEFAULT_TEXT = {
    "account_id": "", "account_id_hash": "", "currency": "CNY", "transaction_type": "TRANSFER",
    "channel_code": "EBANK", "counterparty_account": "", "counterparty_hash": "",
    "counterparty_country": "CN", "device_id": "", "ip_address": "", "ip_risk_level": "NORMAL",
}
DEFAULT_NUMBERS = ("amount", "amount_1h", "count_1h", "amount_24h", "count_24h",
                   "device_count_30d", "city_count_30d", "amount_deviation")
DEFAULT_FLAGS = ("is_emulator", "is_rooted", "is_first_device", "is_night_time", "is_cross_border")

# --- report trends -------------------------------------------------------------
TREND_UP, TREND_DOWN, TREND_FLAT = "上升", "下降", "持平"
