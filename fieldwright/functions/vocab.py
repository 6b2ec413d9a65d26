"""Vocabularies, rules and messages.

Fixed values: every name below must be as it stands for results to agree with the sheets and dictionaries in use, but for KEY_ITEMS,
SUFFIX_SYNONYMS and the pairs of antonyms, which are a house's own tables and stand here as examples: give yours as arguments.
"""

from __future__ import annotations

NUMBER, CODE, ENUM, DATETIME, FLAG, TEXT = "数值类", "编码类", "代码枚举类", "日期时间类", "标志类", "文本类"
CLASSES = [NUMBER, CODE, ENUM, DATETIME, FLAG, TEXT]
NON_ENUM = [NUMBER, CODE, DATETIME, FLAG, TEXT]
ENUM_LIKE = [ENUM, FLAG]
YES, NO = "是", "否"

#: Logical columns of the application sheet and the source names they may have, the first found wins.
SHEET_COLUMNS = {
    "table_name": ["中文表名(必填)"],
    "field_name": ["中文字段名(必填)"],
    "field_type": ["字段所属类型(必填)"],
    "domain_type": ["域类型(必填)"],
    "data_example": ["数据示例(必填)"],
    "is_enum": ["是否枚举(必填)"],
    "business_meaning": ["业务定义(必填)"],
    "enum_values": ["枚举值(选填)"],
    "business_caliber": ["业务口径(选填)", "业务口径"],
}
#: Required columns in the order in which the report lists blank ones.
REQUIRED = [
    ("table_name", "中文表名"), ("field_name", "中文字段名"), ("domain_type", "域类型"), ("data_example", "数据示例"),
    ("field_type", "字段所属类型"), ("is_enum", "是否枚举"), ("business_meaning", "业务定义"),
]

NULL_CELLS = ["nan", "none", "nat"]
NOTHING = "无"
NOTHING_COLUMNS = ["field_name", "field_type", "domain_type", "data_example", "is_enum", "business_meaning", "enum_values"]
NO_ENUM_MARKS = ["-", "—", "－", "/", "／"]
NO_SAMPLE = ["无", "暂无", "无示例", "N/A", "n/a", "NA", "na"]

#: Domain keys that each class may use.
WHITELIST = {
    NUMBER: ["i_int", "i_dec"],
    DATETIME: ["date", "time", "datetime", "timestamp", "n_fix", "n_var", "an_fix", "an_var"],
    TEXT: [f"{f}_{k}" for f in ("a", "n", "c", "an", "nc", "ac", "anc") for k in ("var", "fix", "var_nolimit")],
    CODE: [f"{f}_{k}" for f in ("a", "n", "an", "anc") for k in ("var", "fix")],
}

#: (category, name suffixes, sample lengths without a note, note), in order of precedence. Defaults that name no system: what a house
#: knows of its own numbers is passed in their place.
KEY_ITEMS = [
    ("机构", ["机构编号", "机构号", "机构编码", "网点", "分行", "辖行", "机构代码"], [10, 11], "与内部机构编号的长度不同，请结合业务确认具体口径"),
    ("客户", ["客户号", "客户编号"], [16], "与定长客户号的长度不同，请结合业务确认具体口径"),
    ("员工", ["人工号", "人编号", "柜员号", "柜员编号", "员工号", "柜员", "经理编号"], [7], "与定长员工编号的长度不同，请结合业务确认具体口径"),
    ("产品组", ["产品组编号"], [8], "与产品组标准编号的长度不同，请结合业务确认具体口径"),
    ("基础产品", ["基础产品编号"], [13], "与基础产品标准编号的长度不同，请结合业务确认具体口径"),
    ("可售产品", ["可售产品编号"], [23], "与可售产品标准编号的长度不同，请结合业务确认具体口径"),
    ("产品域层级", ["产品域层级编号"], [2], "与产品域层级编号的长度不同，请结合业务确认具体口径"),
]

#: Offending character per character class: (its pattern, words before it, words after it).
BAD_CHARACTER = {
    "n": ("[^0-9]", "包含非法字符'", "'（数字字符类仅允许数字）"),
    "a": ("[0-9一-鿿]", "包含不允许的字符'", "'（字母+特殊符号类不允许数字和汉字）"),
    "an": ("[一-鿿]", "包含汉字字符'", "'（数字+字母+特殊符号类不允许汉字）"),
    "c": ("[^一-鿿]", "包含非汉字字符'", "'（纯汉字类仅允许汉字）"),
    "nc": ("[^0-9一-鿿]", "包含不允许的字符'", "'（数字+汉字类仅允许数字和汉字）"),
    "ac": ("[0-9]", "包含数字字符'", "'（字母+汉字类不允许数字）"),
    "i": ("[^0-9+.-]", "包含非数字字符'", "'（数值类仅允许数字、小数点和正负号）"),
    "date": ("[^0-9:/ T-]", "包含非法字符'", "'（日期时间类仅允许数字和分隔符-:/空格/T）"),
    "time": ("[^0-9:/ T.-]", "包含非法字符'", "'（日期时间类仅允许数字和分隔符-:/空格/T）"),
    "datetime": ("[^0-9:/ T.-]", "包含非法字符'", "'（日期时间类仅允许数字和分隔符-:/空格/T）"),
    "timestamp": ("[^0-9:/ T.-]", "包含非法字符'", "'（日期时间类仅允许数字和分隔符-:/空格/T）"),
}

SUFFIX_SYNONYMS = [["编号", "号"]]

PASSED, FAILED = "通过", "不通过"
REUSE, MODIFY = "复用", "修改"
NEW_ALL, REUSE_REUSE, MODIFY_REUSE = "新增枚举代码新增标准", "复用枚举代码+复用已有标准", "修改枚举代码+复用已有标准"
NEW_STANDARD = "新增标准"

#: Antonyms that are no complementary pair: graded ones, and directions of a flow.
NOT_COMPLEMENTARY = [("大", "小"), ("高", "低"), ("冷", "热"), ("多", "少"), ("流入", "流出"), ("收款", "付款"), ("借", "贷"), ("买入", "卖出"), ("转入", "转出")]
COMPLEMENTARY = [("是", "否"), ("开启", "关闭"), ("启用", "停用"), ("通过", "不通过"), ("有效", "无效"), ("成功", "失败"), ("允许", "禁止"), ("受理", "不受理"), ("有", "无"), ("完成", "未完成"), ("成立", "不成立")]
