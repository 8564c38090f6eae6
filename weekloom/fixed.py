"""Names, header texts, patterns, labels and limits that results depend on."""

# --- source kinds, in fingerprint order, with the headers each must carry ---------------
FINGERPRINTS = {
    "overall": [
        "Starts", "Ends", "Amount spent (USD)", "Purchases conversion value",
        "Cost per purchase", "Link clicks", "Reporting starts", "Reporting ends",
    ],
    "by_day": [
        "Day", "Adds to cart", "Purchases", "Purchase ROAS (return on ad spend)",
        "Amount spent (USD)", "Purchases conversion value",
    ],
    "by_product": [
        "Campaign name", "Name", "Average purchases conversion value",
        "Purchases conversion value",
    ],
    "campaign": [
        "Campaign name", "Purchases rate per landing page views", "Add to cart Rate",
        "Cost per purchase",
    ],
    "creative": [
        "Ads", "Campaign name", "Cost per add to cart", "Purchase ROAS (return on ad spend)",
    ],
    "traffic_campaign": [
        "Campaign name", "Landing page views", "Cost per landing page view",
        "Landing page views rate per link clicks",
    ],
    "audience": [
        "Ad Set Name", "Adds to cart", "Purchases conversion value", "Amount spent (USD)",
    ],
    "keyword": ["Keyword", "Conversions", "Conv. value / cost", "Cost", "Conv. value"],
}
KINDS = list(FINGERPRINTS)
START_HEADER = "Reporting starts"
END_HEADER = "Reporting ends"

# --- accepted spellings of the average purchase value column, by priority ----------------
AVERAGE_VALUE_HEADERS = [
    "Website purchase average order value (USD)",
    "BRAND A: website Purchase average order value (USD)",
]
# historical exports put the vendor's own name before this text
VENDOR_AVERAGE_VALUE_HEADER = "{vendor}: website Purchase 客单价 (USD)"

# --- transform texts recorded in lineage ------------------------------------------------
IDENTITY = "identity"
TIMES_100 = "multiply by 100 (ratio to percentage points)"
UNQUOTE = "strip enclosing quote characters"
ISO_DATE = "ISO date"
CART_RATE = "adds_to_cart / link_clicks * 100 (percentage points)"
FROM_HISTORY = "latest history record with period_end before current period_start"

# --- published field -> (source header, value type) per section -------------------------
ROAS = "Purchase ROAS (return on ad spend)"
CTR = "CTR (link click-through rate)"
CPM = "CPM (cost per 1,000 impressions)"
CPC = "CPC (cost per link click)"
SPENT = "Amount spent (USD)"
VALUE = "Purchases conversion value"
AVERAGE_VALUE = None  # resolved per file from AVERAGE_VALUE_HEADERS

SECTION_FIELDS = {
    "overall": {
        "amount_spent": (SPENT, "number"),
        "purchase_value": (VALUE, "number"),
        "purchase_roas": (ROAS, "number"),
        "purchases": ("Purchases", "integer"),
        "adds_to_cart": ("Adds to cart", "integer"),
        "cost_per_purchase": ("Cost per purchase", "number"),
        "cost_per_add_to_cart": ("Cost per add to cart", "number"),
        "link_clicks": ("Link clicks", "integer"),
        "ctr": (CTR, "number"),
    },
    "daily": {
        "day": ("Day", "date"),
        "adds_to_cart": ("Adds to cart", "integer"),
        "purchases": ("Purchases", "integer"),
        "purchase_roas": (ROAS, "number"),
        "amount_spent": (SPENT, "number"),
        "purchase_value": (VALUE, "number"),
    },
    "summary": {
        "campaign_name": ("Campaign name", "text"),
        "adds_to_cart": ("Adds to cart", "integer"),
        "purchases": ("Purchases", "integer"),
        "purchase_roas": (ROAS, "number"),
        "average_purchase_value": ("Average purchases conversion value", "number"),
        "purchase_value": (VALUE, "number"),
        "amount_spent": (SPENT, "number"),
    },
    "campaign": {
        "campaign_name": ("Campaign name", "text"),
        "amount_spent": (SPENT, "number"),
        "purchase_value": (VALUE, "number"),
        "purchase_roas": (ROAS, "number"),
        "purchases": ("Purchases", "integer"),
        "adds_to_cart": ("Adds to cart", "integer"),
        "cost_per_purchase": ("Cost per purchase", "number"),
        "cost_per_add_to_cart": ("Cost per add to cart", "number"),
        "purchase_rate": ("Purchases rate per landing page views", "hundredfold"),
        "add_to_cart_rate": ("Add to cart Rate", "hundredfold"),
        "impressions": ("Impressions", "integer"),
        "link_clicks": ("Link clicks", "integer"),
        "ctr": (CTR, "number"),
        "cpm": (CPM, "number"),
        "cpc": (CPC, "number"),
        "average_purchase_value": (AVERAGE_VALUE, "number"),
    },
    "creative": {
        "ad_name": ("Ads", "text"),
        "campaign_name": ("Campaign name", "text"),
        "amount_spent": (SPENT, "number"),
        "cpm": (CPM, "number"),
        "cpc": (CPC, "number"),
        "ctr": (CTR, "number"),
        "cost_per_add_to_cart": ("Cost per add to cart", "number"),
        "cost_per_purchase": ("Cost per purchase", "number"),
        "purchase_roas": (ROAS, "number"),
        "average_purchase_value": (AVERAGE_VALUE, "number"),
        "adds_to_cart": ("Adds to cart", "integer"),
        "purchases": ("Purchases", "integer"),
    },
    "traffic": {
        "campaign_name": ("Campaign name", "text"),
        "amount_spent": (SPENT, "number"),
        "purchases": ("Purchases", "optional_integer"),
        "adds_to_cart": ("Adds to cart", "optional_integer"),
        "impressions": ("Impressions", "integer"),
        "link_clicks": ("Link clicks", "integer"),
        "ctr": (CTR, "number"),
        "cpm": (CPM, "number"),
        "cpc": (CPC, "number"),
        "landing_page_views": ("Landing page views", "integer"),
        "cost_per_landing_page_view": ("Cost per landing page view", "number"),
        "landing_page_view_rate": ("Landing page views rate per link clicks", "number"),
    },
    "audience": {
        "ad_set_name": ("Ad Set Name", "text"),
        "adds_to_cart": ("Adds to cart", "integer"),
        "purchases": ("Purchases", "integer"),
        "purchase_roas": (ROAS, "number"),
        "purchase_value": (VALUE, "number"),
        "amount_spent": (SPENT, "number"),
    },
    "keywords": {
        "keyword": ("Keyword", "keyword"),
        "conversions": ("Conversions", "number"),
        "conversion_value_per_cost": ("Conv. value / cost", "number"),
        "cost": ("Cost", "number"),
        "conversion_value": ("Conv. value", "number"),
    },
}
SECTION_KIND = {
    "overall": "overall", "daily": "by_day", "summary": "by_product", "campaign": "campaign",
    "creative": "creative", "traffic": "traffic_campaign", "audience": "audience",
    "keywords": "keyword",
}
OVERALL_METRICS = [
    "amount_spent", "purchase_value", "purchase_roas", "purchases", "adds_to_cart",
    "cost_per_purchase", "cost_per_add_to_cart", "link_clicks", "ctr", "add_to_cart_rate",
]

# --- week-over-week scopes, metric order and metric classes -----------------------------
SCOPES = ["overall", "product_campaign", "audience", "traffic"]
SCOPE_METRICS = {
    "overall": OVERALL_METRICS,
    "product_campaign": [
        "amount_spent", "purchase_value", "purchase_roas", "purchases", "adds_to_cart",
        "cost_per_purchase", "cost_per_add_to_cart", "purchase_rate", "add_to_cart_rate",
        "impressions", "link_clicks", "ctr", "cpm", "cpc", "average_purchase_value",
    ],
    "audience": ["adds_to_cart", "purchases", "purchase_roas", "purchase_value", "amount_spent"],
    "traffic": [
        "amount_spent", "purchases", "adds_to_cart", "impressions", "link_clicks", "ctr",
        "cpm", "cpc", "landing_page_views", "cost_per_landing_page_view",
        "landing_page_view_rate",
    ],
}
PREFERRED_METRICS = {
    "product_campaign": [
        "purchase_roas", "purchases", "cost_per_purchase", "purchase_value", "amount_spent",
        "adds_to_cart",
    ],
    "audience": ["purchase_roas", "purchases", "adds_to_cart", "purchase_value", "amount_spent"],
    "traffic": [
        "landing_page_view_rate", "cost_per_landing_page_view", "ctr", "cpc",
        "landing_page_views", "link_clicks",
    ],
}
# metric: (unit, which direction is good, label zh, label en)
METRICS = {
    "amount_spent": ("currency", "neutral", "广告花费", "Amount spent"),
    "purchase_value": ("currency", "up", "购买价值", "Purchase value"),
    "purchase_roas": ("ratio", "up", "购买广告回报", "Purchase ROAS"),
    "purchases": ("count", "up", "购买次数", "Purchases"),
    "adds_to_cart": ("count", "up", "加购次数", "Adds to cart"),
    "cost_per_purchase": ("currency", "down", "单次购买成本", "Cost per purchase"),
    "cost_per_add_to_cart": ("currency", "down", "单次加购成本", "Cost per add to cart"),
    "link_clicks": ("count", "neutral", "链接点击", "Link clicks"),
    "impressions": ("count", "neutral", "展示次数", "Impressions"),
    "ctr": ("percentage_points", "up", "点击率", "CTR"),
    "add_to_cart_rate": ("percentage_points", "up", "加购率", "Add-to-cart rate"),
    "purchase_rate": ("percentage_points", "up", "购买率", "Purchase rate"),
    "cpm": ("currency", "down", "千次展示成本", "CPM"),
    "cpc": ("currency", "down", "单次点击成本", "CPC"),
    "average_purchase_value": ("currency", "up", "平均购买价值", "Average purchase value"),
    "landing_page_views": ("count", "up", "落地页浏览", "Landing-page views"),
    "cost_per_landing_page_view": (
        "currency", "down", "单次落地页浏览成本", "Cost per landing-page view"),
    "landing_page_view_rate": (
        "percentage_points", "up", "落地页浏览率", "Landing-page-view rate"),
}
SCOPE_LABELS = {
    "overall": ("整体", "Overall"),
    "product_campaign": ("产品广告系列", "Product campaign"),
    "audience": ("受众", "Audience"),
    "traffic": ("引流广告系列", "Traffic campaign"),
}
MAX_PER_SCOPE = 6
MAX_CANDIDATES = 18
UNSAFE_LABEL = "[unsafe entity label omitted]"

# --- prose patterns, first match names the reason ---------------------------------------
UNSAFE_PROSE = [
    (r"(?i)(?:https?|ftp|file)://|\bwww\.", "URL"),
    (r"(?<![A-Za-z0-9_:])(?:~|/)[^\s<>\]\[{}]+", "filesystem path"),
    (r"(?<![A-Za-z0-9_])\.\.?[\\/][^\s<>\]\[{}]+", "filesystem path"),
    (r"\b[A-Za-z]:[\\/]", "filesystem path"),
    (r"(?i)`|\$\(|&&|\|\||<script|;\s*(?:rm|cp|mv|chmod|chown|curl|wget|"
     r"sudo|bash|zsh|sh|python|pip|powershell|osascript)\b", "command syntax"),
    (r"(?i)ignore (?:all |any |the )?(?:previous |prior )?"
     r"(?:instructions?|prompts?|rules?|directives?)"
     r"|system prompt|developer message|prompt injection|jailbreak"
     r"|disregard (?:all |any |the )?(?:previous |prior )?"
     r"(?:instructions?|prompts?|rules?|directives?)"
     r"|forget (?:all |any |the )?(?:previous |prior )?"
     r"(?:instructions?|prompts?|rules?|directives?)"
     r"|follow (?:these|the) instructions?|execute (?:this |the )?command"
     r"|run (?:this |the )?command|\b(?:curl|wget|sudo)\b|rm\s+-rf",
     "instruction or command wording"),
    (r"忽略.{0,12}(?:指令|提示|要求|规则)|系统提示|开发者消息|提示注入|越狱|"
     r"执行.{0,8}命令|运行.{0,8}命令", "instruction or command wording"),
]
DIGIT_TOKEN = r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*"
NUMBER_WORDS = (
    "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|"
    "fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|"
    "eighty|ninety|hundred|thousand|million|billion|percent|percentage"
)
NUMBER_WORDS_ZH = (
    "百分之|百分点|[零〇一二两三四五六七八九十百千万亿]+(?:点[零〇一二两三四五六七八九]+)?"
    "(?:倍|元|美元|欧元|英镑|次|个|周|天)"
)
FINDING_CODE = r"^[A-Z][A-Z_]{1,47}$"
FINDING_LIMITS = {"title_zh": 80, "title_en": 120, "summary_zh": 240, "summary_en": 320}
FINDING_PRIORITIES = ["HIGH", "MEDIUM", "LOW"]

# --- redaction patterns and phrases -----------------------------------------------------
URL_TEXT = r"(?i)(?:https?://|file://|www\.)[^\s<>\]\[{}]+"
WINDOWS_PATH = r"(?i)(?<![A-Za-z0-9_])[A-Z]:[\\/][^\s<>\]\[{}]+"
POSIX_PATH = r"(?<![A-Za-z0-9_:])(?:~|/)[^\s<>\]\[{}]+"
RELATIVE_PATH = r"(?<![A-Za-z0-9_])\.\.?[\\/][^\s<>\]\[{}]+"
INJECTION = (
    r"(?is)(?:ignore\s+(?:all\s+|any\s+|the\s+)?(?:previous\s+)?instructions?"
    r"|system\s+prompt|developer\s+message|prompt\s+injection|jailbreak"
    r"|(?:run|execute)\s+(?:this\s+)?(?:command|script|shell)"
    r"|rm\s+-rf|sudo\s+|curl\s+|wget\s+|powershell\s+|<script\b"
    r"|忽略.{0,12}(?:指令|提示|规则)|执行.{0,8}(?:命令|脚本)|系统提示)"
)
SHELL_COMMAND = (
    r"(?i)(?:^|[\s`$>])(?:sudo|rm|cp|mv|chmod|chown|curl|wget|python\d*|"
    r"pip\d*|bash|zsh|powershell|cmd\.exe|osascript)\s+"
)
REDACTED = {  # situation: (phrase for a message, phrase for a list item)
    "instruction": ("untrusted diagnostic detail withheld", "untrusted item"),
    "url": ("diagnostic detail with local references withheld", "external reference"),
    "path": ("diagnostic detail with local references withheld", "local file"),
    "empty": ("diagnostic detail unavailable", "unspecified item"),
}
MESSAGE_LIMIT = 1200
ITEM_LIMIT = 100

# --- diagnostics ------------------------------------------------------------------------
RAW_ITEM_LIMIT = 160
RAW_ERROR_TYPE_LIMIT = 80
MAX_MISSING = 20
MAX_DUPLICATE_GROUPS = 20
MAX_DUPLICATE_ITEMS = 12
MAX_AFFECTED = 12
PERIOD_ITEM = "报告周期 / Reporting period"
EXPLANATION_LIMITS = {"title_zh": 80, "title_en": 80, "summary_zh": 300, "summary_en": 300}
STEP_LIMIT = 200
CATEGORY_KEYWORDS = [
    ("period_conflict", ["period", "date", "日期"]),
    ("product_alias", ["alias", "no configured product", "产品别名"]),
    ("creative_pin", ["creative pin", "creative_pin", "pinned", "创意固定"]),
    ("validation", ["reportvalidation", "validation", "校验"]),
]
# category: (title zh, title en, summary zh, summary en, [(step zh, step en)])
EXPLANATIONS = {
    "missing_sources": (
        "缺少必需数据表", "Required source tables are missing",
        "输入资料不完整，系统暂时无法生成可靠的周报。",
        "The input set is incomplete, so a reliable weekly report cannot be generated yet.",
        [("补齐下方列出的数据类型，每种类型只保留一份本周文件。",
          "Add each data type listed below and keep one current-week file for each type."),
         ("确认文件可正常打开，且表头和数据行没有被删除。",
          "Confirm that every file opens normally and still contains its headers and data rows."),
         ("重新选择完整的输入资料后再次生成。",
          "Select the completed input set and generate the report again.")]),
    "duplicate_sources": (
        "发现重复数据源", "Duplicate source tables were found",
        "同一种数据类型出现了多份候选文件，系统无法安全判断应该使用哪一份。",
        "More than one candidate was found for the same data type, "
        "so the app cannot safely choose one.",
        [("核对重复文件的报告周期和更新时间，确认哪一份是本周最终版本。",
          "Compare the reporting period and update time, "
          "then identify the final current-week version."),
         ("每种数据类型只保留一份输入文件，并将其余版本移出本次输入资料。",
          "Keep one input file per data type and move the other versions "
          "out of this input set."),
         ("重新选择整理后的输入资料并再次生成。",
          "Select the cleaned input set and generate the report again.")]),
    "period_conflict": (
        "报告周期不一致", "Reporting periods do not match",
        "输入文件中的日期范围不一致，混用这些数据可能造成周报口径错误。",
        "The input files contain different date ranges, "
        "which could make the weekly report inconsistent.",
        [("逐一核对所有输入文件的开始日期、结束日期和时区。",
          "Check the start date, end date, and time zone in every input file."),
         ("替换不属于同一报告周期的文件，或修正其中的日期字段。",
          "Replace files from a different reporting period or correct their date fields."),
         ("确认全部文件覆盖同一周期后再次生成。",
          "Generate again after all files cover the same reporting period.")]),
    "product_alias": (
        "产品名称尚未匹配", "A product name could not be matched",
        "输入中的产品名称没有对应到已配置的标准产品，相关数据无法安全归类。",
        "A product name in the input does not map to a configured product, "
        "so its data cannot be classified safely.",
        [("确认输入中的产品名称是否存在拼写、空格或版本差异。",
          "Check the input product name for spelling, spacing, or version differences."),
         ("使用已有标准名称，或在确认后新增一个产品别名。",
          "Use an existing standard name or add a confirmed product alias."),
         ("保存更正后再次生成。", "Save the correction and generate again.")]),
    "creative_pin": (
        "广告素材无法唯一对应", "A creative asset could not be matched uniquely",
        "素材与广告记录之间缺少唯一对应关系，因此系统不会自动猜测。",
        "The creative asset does not have one unambiguous ad match, "
        "so the app will not guess.",
        [("核对素材名称、广告名称和素材标识是否一致。",
          "Check that the creative name, ad name, and creative identifier agree."),
         ("移除重复对应关系，或补充缺失的唯一标识。",
          "Remove duplicate mappings or add the missing unique identifier."),
         ("确认对应关系后再次生成。", "Confirm the mapping and generate again.")]),
    "validation": (
        "数据校验未通过", "Data validation did not pass",
        "系统发现输入数据不满足周报规则，需要先修正数据后再生成。",
        "The input does not satisfy the report rules and needs correction before generation.",
        [("检查提示涉及的数据类型、必填字段和数值格式。",
          "Review the affected data type, required fields, and number formats."),
         ("在源文件中修正问题，同时保留原有表头结构。",
          "Correct the source data while preserving the expected header structure."),
         ("保存文件后重新校验。", "Save the files and validate again.")]),
    "generation": (
        "报告生成未完成", "Report generation did not finish",
        "输入检查可能已完成，但报告文件在生成或保存阶段没有成功完成。",
        "Input checks may have completed, but the report was not finished "
        "during generation or saving.",
        [("确认模板和输入文件均可正常打开，且没有被其他应用锁定。",
          "Confirm that the template and input files open normally "
          "and are not locked by another app."),
         ("确认保存位置仍有足够空间并允许写入。",
          "Confirm that the save location has enough space and allows writing."),
         ("关闭占用文件的应用后再次生成。",
          "Close any app using the files and generate again.")]),
    "unknown": (
        "暂时无法完成此操作", "The operation could not be completed",
        "系统遇到了未分类的问题，输入资料不会因此被修改。",
        "The app encountered an unclassified issue and did not modify the input data.",
        [("确认所有输入文件仍可正常打开，并重新选择本次输入资料。",
          "Confirm that all input files still open normally and select the input set again."),
         ("再次尝试；若问题持续出现，请保留错误类型并联系维护人员。",
          "Try again; if the issue persists, keep the error type and contact the maintainer.")]),
}

# --- review contract --------------------------------------------------------------------
REVIEW_VERSION = "1.0.0"
ANOMALY_LIMITS = {"code": 48, "message": 240, "path": 160, "recommended_action": 200}
EVIDENCE_LIMIT = 160
REVIEW_SUMMARY_LIMIT = 300
MAX_ANOMALIES = 3
MAX_EVIDENCE = 3

# --- lineage sample ---------------------------------------------------------------------
MAPPINGS_PER_GROUP = 4
MAPPINGS_TOTAL = 40

# --- sample catalog ---------------------------------------------------------------------
CATALOG_MINIMUM = 10
CATALOG_TARGET = 20
REVIEW_STATUSES = [
    "candidate", "historical_reference", "known_bad_reference", "approved", "expected_fail",
]
WORKFLOW_STATUSES = ["runnable", "needs_adapter", "reference_only"]
PREVIOUS_KINDS = ["catalog_sample", "seed_file"]
BUNDLE_PROFILE = "it_weekly_v1"
DECK_MARKETS = ["FR", "IT", "UK", "AU"]

# --- input limits -----------------------------------------------------------------------
SOURCE_SUFFIXES = [".xlsx", ".csv", ".tsv"]
MAX_CANDIDATE_FILES = 256
KEYWORD_LIMIT = 100
MAX_SOURCE_BYTES = 256 * 1024 * 1024
MAX_ARCHIVE_BYTES = 1024 * 1024 * 1024
HEADER_SCAN_ROWS = 20
BLANK_TAIL_ROWS = 100
DIALECT_PROBE_CHARS = 4096
