"""Word lists, patterns and codes that results depend on."""

# Polite address in questions to a company; the delimiter is kept.
SALUTATION = "请问[\\x{4e00}-\\x{9fa5}\\s]+?([，、：])"
GREETING = "[\\x{4e00}-\\x{9fa5}]+(?:[你您]+)?\\s*(?:好|您好|你好)\\s*[，、！]"

# Characters for zero and one to nine.
CHINESE_DIGITS = ["零", "〇", "○", "一", "二", "三", "四", "五", "六", "七", "八", "九"]

# Markers of a draft revision in a document title.
REVISION_MARKS = ["修订", "修正稿", "修改草案"]

# Name resolution.
BANK_SHORT_NAMES = {"建设银行": "中国建设银行", "建行": "中国建设银行"}
FINANCE_BRANDS = {"美团": "美团借钱", "哈啰": "哈啰金融", "唯品会": "唯品花", "去哪儿网": "去哪儿网金融"}
FINANCE_WORDS = ["借钱", "贷款", "还款", "催收", "借款", "利息", "利率", "砍头息"]
SERVICE_DESK = "客服"
UNASSIGNED_NOTE = "商家只有匹配成功"
UNASSIGNED_PROGRESS = "待分配"

# Match states of a resolved name.
UNASSIGNED, UNMATCHED, MATCHED, MATCHED_FROM_NOTE = 0, 1, 2, 3

# Wording of stored yes/no answers.
YES, NO = "是", "否"
NEGATIVE_VERDICTS = [
    "不是", "不直接涉及", "无关", "不属于", "没有直接关联", "并非", "不涉及", "相关性不大", "相关的程度较低",
    "没有直接关系", "相关的可能性较低", "非直接相关",
]
POSITIVE_VERDICTS = ["是", "相关", "是的", "有关"]
UNCLEAR_VERDICT = "未完全识别"

# Date layouts tried in order.
DATE_LAYOUTS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy年MM月dd日", "yyyy.MM.dd", "yyyyMMdd"]

# Words that mark the old and the new wording in clause changes.
ORIGINAL_MARKS = [
    "原内容", "原章程", "原条款", "原规定", "原规则", "原规章", "原规范", "原第", "原议事", "现条款", "修订前",
    "原《公司章程》", "原表述", "原文", "变更前", "修改前", "现有章程", "原制度", "原公司章程", "原条文", "原“第",
    "原：“第", "现章程", "现行《公司章程》", "现行条款", "现有条文", "先行章程", "现行公司章程", "现行章程",
]
APPEND_MARKS = [
    "增加第", "新增第", "新增一", "新增条款", "增加“", "增加一", "增加二", "增加三", "增加四", "增加五", "增加六",
    "增加七", "增加八", "增加九", "增加十", "增加了", "顺延为", "增加如下", "新增以下", "增加条目",
]
# Entries that another entry contains are left out: they find nothing more.
MODIFIED_MARKS = [
    "修改后", "修订后", "修订为", "现修订", "修改为", "新增", "变更后", "变更为", "修订条款", "修订规定", "修订规则",
    "修订规章", "修订规范", "修订第", "增加第", "改为：", "更为：", "更改为", "删除", "改为第", "改为“", "顺延为",
    "增加“", "顺延：", "顺延，", "增加一", "增加二", "增加三", "增加四", "增加五", "增加六", "增加七", "增加八",
    "增加九", "增加十", "增加了", "新条款", "修改内容", "修改作为", "拟修订", "修订建议", "修订内容", "建议修改内容",
    "次会议修订", "增加如下", "条款内容", "新增以下", "增加条目", "如下修改：", "修订稿",
]
END_MARKS = ["附：《公司章程", "（修订稿）", "《公司章程》全文如下", "《公司章程》（草案）全文", "股东大会议事规则"]
TABOO_MARKS = ["审议机构", "年", "是否提交股东大会", "持股比例"]
CLAUSE_NUMBER = "第[一二三四五六七八九十百千]+条"
SHORT_LINE = 15
CLAUSE_CATEGORIES = [
    ("公司基本信息变更", ["注册资本", "经营范围", "经营宗旨", "公司名称", "公司住所", "法人代表", "营业执照", "办公地址", "注册地址"]),
    ("涉及中小投资者保护的相关条例", ["中小投资者", "表决权", "投票权", "利润分配", "网络投票", "累积投票", "征集投票", "独立董事", "提案权", "股东权益保护", "小股东"]),
    ("反收购条款", ["收购", "要约收购", "恶意收购", "反收购", "全仓牌", "董事提名权", "监事提名", "高管资格", "投票比例限制", "职工董事", "决议方法", "表决权限制"]),
    ("基于法规的公司内部权力配置条款", ["股东大会", "董事会", "监事会", "总经理", "权力", "职权", "权限", "议事规则"]),
    ("自主安排的管理层权力配置条款", ["董事会", "监事会", "高管", "总经理", "管理层", "决策权", "任免权", "薪酬"]),
]
OTHER_CATEGORY = "其他"

# What follows a field name in an answer whose JSON can't be repaired, and the levels of confidence.
RESCUED_VALUE = "[\"':\\s]+([^\",}'\\n]+)"
RELATED_WORDS = ["true", "相关", "是"]
UNRELATED_WORDS = ["false", "不相关", "否"]
CONFIDENCE_LEVELS = ["高", "中", "低"]

# Where code lists and their reasons stand in an answer.
CODE_BLOCK = r"\*\*分类序号：\*\*([\s\S]*?)(?:\*\*理由：\*\*|$)"
CODE_HEADER = r"(?i)^(?:分类|类别|分类序号)[：:\s]*([\d\s，、,-]+)"
CODE_WORD = r"\b(\d{1,3})\b"
CODE_REASON = r"\*\*理由：\*\*([\s\S]*)$"
