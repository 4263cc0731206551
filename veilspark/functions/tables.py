"""Word lists, levels, pools, scores and limits that decide results."""

ENTITY_TYPES = ("PERSON", "ORG", "LOCATION", "ADDRESS", "PHONE", "EMAIL", "ID_CARD", "BANK_CARD", "PASSPORT", "CUSTOM")
STRATEGIES = ("mask", "pseudonymize", "generalize")
LANGUAGES = ("auto", "zh", "en", "mixed", "multilingual")
#: Types that the language gate and the knowledge lookup look at.
NAMED_TYPES = ("PERSON", "ORG", "LOCATION", "ADDRESS")

#: A span scored lower waits for review.
ACCEPT_SCORE = 0.82
NER_SCORE = 0.70

ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CODES = "10X98765432"

ORG_SUFFIXES = ("大学", "学院", "医院", "研究院", "委员会", "有限公司", "集团", "银行")
ORG_VERBS = ("就读于", "任职于", "来自", "工作于", "毕业于", "供职于", "隶属于")
ORG_WORDS_EN = ("University", "College", "Hospital", "Institute", "Company", "Corporation")
GAZETTEER = ("北京市", "上海市", "天津市", "重庆市", "浙江省", "江苏省", "广东省", "四川省", "海淀区", "朝阳区", "杭州", "北京", "上海", "广州", "深圳", "London", "Beijing", "Shanghai", "New York", "Tokyo", "Singapore")

RISK_HEAVY = ("ID_CARD", "BANK_CARD", "PASSPORT")
RISK_HEAVY_WEIGHT, RISK_WEIGHT, RISK_CAP, RISK_HIGH, RISK_MEDIUM = 18, 10, 100, 60, 25

GENERIC_LEVELS = {
    "PERSON": ("某位受访者", "某人", "自然人"),
    "ORG": ("某同类机构", "某机构", "组织实体"),
    "LOCATION": ("某同级地区", "某地区", "地理区域"),
    "ADDRESS": ("某市某区", "某地详细地址", "地理位置"),
    "PHONE": ("尾号已隐藏的电话", "某联系电话", "联系方式"),
    "EMAIL": ("某域名邮箱", "某邮箱", "电子联系方式"),
    "ID_CARD": ("某证件号码", "某身份证件", "身份标识"),
    "BANK_CARD": ("某支付卡号", "某银行卡号", "金融账户标识"),
    "PASSPORT": ("某护照号码", "某护照", "旅行证件"),
    "CUSTOM": ("某自定义敏感项", "敏感内容", "受保护信息"),
}
EXACT_LEVELS = {
    "中国人民大学": ("北京高校", "高等院校", "教育机构"),
    "北京大学": ("北京高校", "高等院校", "教育机构"),
    "清华大学": ("北京高校", "高等院校", "教育机构"),
    "复旦大学": ("上海高校", "高等院校", "教育机构"),
    "上海交通大学": ("上海高校", "高等院校", "教育机构"),
    "北京市": ("华北直辖市", "中国城市", "地理区域"),
    "上海市": ("华东直辖市", "中国城市", "地理区域"),
    "广州市": ("华南省会城市", "中国城市", "地理区域"),
    "深圳市": ("华南副省级城市", "中国城市", "地理区域"),
    "海淀区": ("北京城区", "城市辖区", "地理区域"),
    "浦东新区": ("上海城区", "城市辖区", "地理区域"),
}
#: (words in the term, words in the lower-cased term, levels), in order of precedence.
ORG_INFERENCE = (
    (("大学", "学院"), ("university", "college"), ("某同地区高校", "高等院校", "教育机构")),
    (("医院",), ("hospital",), ("某同地区医院", "医疗机构", "公共服务机构")),
    (("公司", "集团", "企业"), ("company", "corp", "ltd", "group"), ("某同业企业", "企业机构", "组织实体")),
    (("研究院", "研究所", "实验室"), ("institute", "laboratory", "lab"), ("某同领域科研机构", "科研机构", "组织实体")),
)
#: (suffixes, levels); 自治区 ends in 区, so the first line takes it.
PLACE_SUFFIXES = (
    (("区", "县"), ("某同市辖区", "城市辖区", "地理区域")),
    (("市", "州", "盟"), ("某同区域城市", "城市", "地理区域")),
    (("省", "自治区"), ("某同区域省份", "省级行政区", "地理区域")),
)
PLACE_WORDS = (("路", "街", "巷", "号", "小区", "大厦"), ("某同区域地址", "详细地址", "地理位置"))

PSEUDONYMS = {
    "PERSON": ("林清", "陈默", "Alex Morgan", "周然", "李安", "Taylor Reed"),
    "ORG": ("华东某高校", "某研究机构", "Northbridge Institute", "某科技公司"),
    "LOCATION": ("华东某市", "某沿海城市", "Central District", "某省会城市"),
    "ADDRESS": ("某市某区学府路18号", "某城区中心大道88号", "[REDACTED ADDRESS]"),
}
EPSILON = {1: 0.25, 2: 1.0, 3: 4.0}
EMAIL_DOMAINS = ("example.org", "example.net", "masked.invalid")
VECTOR_ORG = ("大学", "学院", "公司", "集团", "医院", "机构")
VECTOR_ORG_EN = ("university", "college", "company", "institute", "hospital")
VECTOR_PLACE = ("省", "市", "区", "县", "路", "街", "号")
VECTOR_PLACE_EN = ("street", "road", "district", "city")

TYPE_ALIASES = {
    "PERSON": ("人名", "姓名", "名字", "person", "name"),
    "ORG": ("机构", "组织", "公司", "学校", "医院", "organization", "company"),
    "LOCATION": ("地名", "地点", "地区", "城市", "location", "place"),
    "ADDRESS": ("地址", "住址", "详细地址", "address"),
    "PHONE": ("电话", "手机号", "手机", "phone", "telephone"),
    "EMAIL": ("邮箱", "电子邮件", "email", "e-mail"),
    "ID_CARD": ("身份证", "证件号", "身份证号", "id card"),
    "BANK_CARD": ("银行卡", "银行卡号", "bank card"),
    "PASSPORT": ("护照", "护照号", "passport"),
}
STRATEGY_WORDS = (
    ("generalize", ("泛化", "模糊化", "上位概念", "generalize")),
    ("pseudonymize", ("差分隐私", "语义替换", "伪名", "pseudonym")),
    ("mask", ("掩码", "mask", "占位符")),
)
STRENGTH_WORDS = (
    (3, ("最高强度", "高强度", "严格", "强保护")),
    (1, ("低强度", "轻度", "尽量保留语义")),
    (2, ("中等", "标准")),
)
ONLY_SCOPE = r"(?:仅|只|只需|只要|only).{0,8}(?:脱敏|处理|隐藏|mask|redact)"
KEEP_WORDS = r"(?i)(?:保留|不要脱敏|无需脱敏|keep)\s*[“\"']?([^，。；;\n\"'”]{1,80})"
FORCE_WORDS = r"(?i)(?:必须脱敏|额外脱敏|隐去|隐藏|屏蔽|redact)\s*[“\"']?([^，。；;\n\"'”]{1,80})"
KEEP_CUT = r"(?:但|并且|同时|except|but)"
TERM_SUFFIX = r"(?i)(?:的)?(?:人名|姓名|名字|机构|组织|公司|学校|医院|地名|地点|地区|城市|详细地址|地址|手机号|手机|电话|邮箱|电子邮件|身份证号?|证件号|银行卡号?|护照号?)$"
NOT_TERMS = ("所有", "全部")

RISK_WORDS = r"(?i)(?=[我姓联住地电手邮身银微就wcaepm])(?:我叫|姓名|联系人|住在|地址|电话|手机|邮箱|身份证|银行卡|微信|就职|work(?:s|ed)? at|contact|address|email|phone|my name)"
ROUTED_SENTENCES, ROUTED_CHARS = 8, 1200
SENTENCE_END = "。！？!?\n"
MAX_TEXT, MAX_RECORDS, PREVIEW, CONTEXT = 100_000, 500, 80, 35
MAX_FILE_BYTES = 20_000_000
HISTORY_ROWS, AUDIT_ROWS, REVIEW_ROWS, JOB_ROWS = 30, 50, 100, 30
