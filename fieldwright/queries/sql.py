"""Pieces of DuckDB SQL that several oracles share. Written apart from the operators: they are what the operators are checked against."""

from __future__ import annotations

#: Expected values, stated here once more on purpose: the oracle shares nothing with the library.
BAD_CHARACTER = {
    "n": ("包含非法字符'", "'（数字字符类仅允许数字）"), "a": ("包含不允许的字符'", "'（字母+特殊符号类不允许数字和汉字）"), "an": ("包含汉字字符'", "'（数字+字母+特殊符号类不允许汉字）"),
    "c": ("包含非汉字字符'", "'（纯汉字类仅允许汉字）"), "nc": ("包含不允许的字符'", "'（数字+汉字类仅允许数字和汉字）"), "ac": ("包含数字字符'", "'（字母+汉字类不允许数字）"),
    "i": ("包含非数字字符'", "'（数值类仅允许数字、小数点和正负号）"), "date": ("包含非法字符'", "'（日期时间类仅允许数字和分隔符-:/空格/T）"), "time": ("包含非法字符'", "'（日期时间类仅允许数字和分隔符-:/空格/T）"),
    "datetime": ("包含非法字符'", "'（日期时间类仅允许数字和分隔符-:/空格/T）"), "timestamp": ("包含非法字符'", "'（日期时间类仅允许数字和分隔符-:/空格/T）"),
}
WHITELIST = {
    "数值类": ["i_int", "i_dec"],
    "日期时间类": ["date", "time", "datetime", "timestamp", "n_fix", "n_var", "an_fix", "an_var"],
    "文本类": ["a_var", "a_fix", "a_var_nolimit", "n_var", "n_fix", "n_var_nolimit", "c_var", "c_fix", "c_var_nolimit", "an_var", "an_fix", "an_var_nolimit", "nc_var", "nc_fix", "nc_var_nolimit", "ac_var", "ac_fix", "ac_var_nolimit", "anc_var", "anc_fix", "anc_var_nolimit"],
    "编码类": ["a_var", "a_fix", "n_var", "n_fix", "an_var", "an_fix", "anc_var", "anc_fix"],
}
#: Key-item rules of a made-up house, given to the operator as its argument.
KEY_ITEMS = [
    ("机构", ["机构编号", "机构号", "网点"], [10, 11], "请核对机构编号"), ("客户", ["客户号", "客户编号"], [16], "请核对客户号"), ("员工", ["柜员号", "员工号"], [7], "请核对员工编号"),
    ("产品组", ["产品组编号"], [8], "请核对产品组编号"),
]

NO_SAMPLE = "('无', '暂无', '无示例', 'N/A', 'n/a', 'NA', 'na')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g')"


def in_list(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def domain_key(c: str) -> str:
    s = strip(c)
    fam = "(anc|an|ac|nc|n|a|c)"
    return f"""CASE
      WHEN regexp_full_match({s}, '{fam}!\\(\\d+\\)') THEN regexp_extract({s}, '^([a-z]+)', 1) || '_fix'
      WHEN regexp_full_match({s}, '{fam}\\.\\.\\(\\d+\\)') THEN regexp_extract({s}, '^([a-z]+)', 1) || '_var'
      WHEN regexp_full_match({s}, '{fam}\\.\\.\\(\\)') THEN regexp_extract({s}, '^([a-z]+)', 1) || '_var_nolimit'
      WHEN regexp_full_match({s}, 'i\\(\\d+\\)') THEN 'i_int'
      WHEN regexp_full_match({s}, 'i\\(\\d+,\\s*\\d+\\)') THEN 'i_dec'
      WHEN lower({s}) IN ('date', 'time', 'datetime', 'timestamp') THEN lower({s}) END"""


def domain_x(c: str) -> str:
    return f"TRY_CAST(regexp_extract({c}, '\\((\\d+)', 1) AS BIGINT)"


def domain_y(c: str) -> str:
    return f"TRY_CAST(regexp_extract({c}, ',\\s*(\\d+)\\)', 1) AS BIGINT)"


_CLASSES = {"n": "[^0-9]", "a": "[0-9\\x{4e00}-\\x{9fff}]", "an": "[\\x{4e00}-\\x{9fff}]", "c": "[^\\x{4e00}-\\x{9fff}]", "nc": "[^0-9\\x{4e00}-\\x{9fff}]", "ac": "[0-9]", "i": "[^0-9+.\\-]", "date": "[^0-9:/ T\\-]", "time": "[^0-9:/ T.\\-]", "datetime": "[^0-9:/ T.\\-]", "timestamp": "[^0-9:/ T.\\-]"}


def char_fault(s: str, key: str) -> str:
    arms = []
    for k, p in _CLASSES.items():
        before, after = BAD_CHARACTER[k]
        b, a = before.replace("'", "''"), after.replace("'", "''")
        arms.append(f"WHEN split_part({key}, '_', 1) = '{k}' AND regexp_matches({s}, '{p}') THEN '{b}' || regexp_extract({s}, '{p}') || '{a}'")
    return "CASE " + " ".join(arms) + " END"


def length_fault(s: str, key: str, x: str, y: str) -> str:
    """s, key, x, y: column names."""
    digits = f"translate({s}, '-:/ T', '')"
    main, frac = f"split_part({digits}, '.', 1)", f"substr({digits}, strpos({digits}, '.') + 1)"
    whole = f"ltrim(split_part({s}, '.', 1), '+-')"
    dec = f"substr({s}, strpos({s}, '.') + 1)"
    dot, ddot = f"strpos({s}, '.') > 0", f"strpos({digits}, '.') > 0"
    return f"""CASE
      WHEN {key} LIKE '%\\_fix' ESCAPE '\\' THEN CASE WHEN length({s}) <> {x} THEN '长度应为' || {x} || '位，实际' || length({s}) || '位' END
      WHEN {key} LIKE '%\\_var' ESCAPE '\\' THEN CASE WHEN length({s}) > {x} THEN '长度超过最大限制' || {x} || '位，实际' || length({s}) || '位' END
      WHEN {key} = 'i_int' AND {dot} THEN 'i(' || {x} || ')为整数类型，数据示例不应包含小数点'
      WHEN {key} IN ('i_int', 'i_dec') THEN CASE WHEN {whole} = '' THEN '数据示例不是有效的数值'
        WHEN length({whole}) > {x} THEN '整数部分不得超过' || {x} || '位，实际' || length({whole}) || '位'
        WHEN {key} = 'i_dec' AND {dot} AND length({dec}) > {y} THEN '小数部分不得超过' || {y} || '位，实际' || length({dec}) || '位' END
      WHEN {key} = 'date' THEN CASE WHEN length({digits}) NOT BETWEEN 6 AND 8 THEN 'DATE应为6-8位日期数字（YYYYMMDD），实际' || length({digits}) || '位' END
      WHEN {key} = 'time' THEN CASE WHEN length({main}) NOT BETWEEN 3 AND 6 THEN 'TIME应为3-6位时间数字（HHMMSS），实际' || length({main}) || '位'
        WHEN {ddot} AND NOT regexp_full_match({frac}, '[0-9]+') THEN '毫秒部分应为纯数字，实际''' || {frac} || '''' END
      WHEN {key} IN ('datetime', 'timestamp') THEN CASE WHEN length({main}) = 8 THEN upper({key}) || '应为日期时间格式（YYYYMMDDHHmmss，14位），数据示例仅包含日期部分'
        WHEN length({main}) NOT BETWEEN 9 AND 14 THEN upper({key}) || '应为9-14位日期时间数字（YYYYMMDDHHmmss），实际' || length({main}) || '位'
        WHEN {ddot} AND NOT regexp_full_match({frac}, '[0-9]+') THEN '毫秒部分应为纯数字，实际''' || {frac} || '''' END
    END"""


def sample_fault(domain: str, sample: str) -> str:
    s = strip(sample)
    return f"""CASE WHEN ({domain_key(domain)}) IS NULL OR {s} = '' OR {s} IN {NO_SAMPLE} THEN NULL
      ELSE coalesce({char_fault(s, '(' + domain_key(domain) + ')')}, {length_fault(s, '(' + domain_key(domain) + ')', domain_x(domain), domain_y(domain))}) END"""


def items(c: str) -> str:
    part = strip("x")
    return f"list_filter(list_transform(string_split({c}, ';'), lambda x: {part}), lambda x: x <> '')"


def code_of(x: str) -> str:
    return f"(CASE WHEN strpos({x}, '-') > 0 THEN {strip(f'''substr({x}, 1, strpos({x}, '-') - 1)''')} ELSE '' END)"


def value_of(x: str) -> str:
    return f"(CASE WHEN strpos({x}, '-') > 0 THEN {strip(f'''substr({x}, strpos({x}, '-') + 1)''')} ELSE {x} END)"


def valid_items(c: str) -> str:
    """Items whose pair is valid."""
    return f"list_filter({items(c)}, lambda x: {code_of('x')} <> '' AND NOT regexp_matches({code_of('x')}, '[《》]|GB/T|GBT') AND NOT regexp_matches({value_of('x')}, '[《》]|GB/T|GBT'))"


BLANKED = """SELECT row_index, table_name,
  {cells},
  CASE WHEN enum_values IN ('无', '-', '—', '－', '/', '／') THEN '' ELSE enum_values END AS enum_values, business_caliber FROM ({sheet})"""


def blanked(sheet: str) -> str:
    cells = ", ".join(f"CASE WHEN {c} = '无' THEN '' ELSE {c} END AS {c}" for c in ("field_name", "field_type", "domain_type", "data_example", "is_enum", "business_meaning"))
    return BLANKED.format(cells=cells, sheet=sheet)


def _issues() -> dict[str, str]:
    classes = "('数值类', '编码类', '代码枚举类', '日期时间类', '标志类', '文本类')"
    cols = [("table_name", "中文表名"), ("field_name", "中文字段名"), ("domain_type", "域类型"), ("data_example", "数据示例"), ("field_type", "字段所属类型"), ("is_enum", "是否枚举"), ("business_meaning", "业务定义")]
    blank = lambda c: f"{strip(c)} = ''"
    missing = "concat_ws(', ', " + ", ".join(f"CASE WHEN {blank(c)} THEN '{n}' END" for c, n in cols) + ")"
    like = "('代码枚举类', '标志类')"
    given = strip("is_enum")
    listed = "[''数值类'', ''编码类'', ''代码枚举类'', ''日期时间类'', ''标志类'', ''文本类'']"
    allowed = " OR ".join(f"(field_type = '{t}' AND ({domain_key('domain_type')}) IN {in_list(ks)})" for t, ks in WHITELIST.items())
    ruled = f"field_type IN {classes} AND field_type NOT IN {like}"
    return {
        "required": f"CASE WHEN {missing} <> '' THEN '必填字段为空: ' || {missing} END",
        "name": "CASE WHEN field_name <> '' AND NOT regexp_matches(field_name, '[\\x{4e00}-\\x{9fff}]') THEN '字段中文名''' || field_name || '''必须包含至少一个中文字符' END",
        "class": f"CASE WHEN NOT {blank('field_type')} AND field_type NOT IN {classes} THEN '字段所属类型''' || field_type || '''不合法，必须是{listed}中的一种' END",
        "enum": f"""CASE WHEN field_type IN {classes} AND {given} <> '' THEN
          CASE WHEN {given} NOT IN ('是', '否') THEN '''是否枚举''填写为''' || {given} || '''，必须为''是''或''否'''
          WHEN field_type IN {like} AND ({given} = '否' OR {strip('enum_values')} = '') THEN field_type || '字段的''是否枚举''必须为''是''且填写枚举值，实际为''' || {given} || '''且枚举值' || CASE WHEN {strip('enum_values')} <> '' THEN '不为空' ELSE '为空' END
          WHEN field_type NOT IN {like} AND ({given} = '是' OR {strip('enum_values')} <> '') THEN field_type || '字段的''是否枚举''必须为''否''且不填写枚举值，实际为''' || {given} || '''且枚举值' || CASE WHEN {strip('enum_values')} <> '' THEN '不为空' ELSE '为空' END END END""",
        "domain": f"""CASE WHEN {ruled} AND {strip('domain_type')} <> '' THEN CASE WHEN ({domain_key('domain_type')}) IS NULL THEN '域类型''' || domain_type || '''格式不合法'
          WHEN NOT ({allowed}) THEN '域类型''' || domain_type || '''不允许用于字段所属类型''' || field_type || '''' END END""",
        "sample": f"CASE WHEN {ruled} AND {strip('data_example')} <> '' THEN '数据示例''' || data_example || '''不符合域类型''' || domain_type || '''的限制: ' || ({sample_fault('domain_type', 'data_example')}) END",
    }


ISSUES = _issues()


def ruled(sheet: str) -> str:
    """The sheet, blanked, with rule_issues as a list."""
    own = ", ".join(ISSUES.values())
    return f"""SELECT *, list_filter([{own}, CASE WHEN table_name <> '' AND field_name <> '' AND count(*) FILTER (table_name <> '' AND field_name <> '') OVER (PARTITION BY {strip('table_name')}, {strip('field_name')}) > 1
      THEN '字段中文名''' || field_name || '''在表''' || table_name || '''中重复' END], lambda x: x IS NOT NULL) AS issues FROM ({blanked(sheet)})"""


def key_note() -> str:
    token = strip("data_example")
    for mark in ("；", ";", "，", ",", "、"):
        token = strip(f"split_part({token}, '{mark}', 1)")
    arms = []
    for cat, suffixes, lengths, note in KEY_ITEMS:
        hit = " OR ".join(f"suffix({strip('field_name')}, '{s}')" for s in suffixes)
        arms.append(f"WHEN {hit} THEN CASE WHEN length({token}) NOT IN ({', '.join(map(str, lengths))}) THEN '{cat}类字段数据示例长度为' || length({token}) || '位，{note}' END")
    return f"CASE WHEN {token} = '' THEN NULL {' '.join(arms)} END"
