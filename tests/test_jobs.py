"""The jobs from end to end against plain Python, the scorers' contract, and the written cases."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwright.functions import names
from fieldwright.functions.vocab import BAD_CHARACTER, WHITELIST
from fieldwright.operators import enummap, quality, report, retrieve, scoring
from fieldwright.plans import jobs
from fieldwright.queries import sql
from fieldwright.sources import tables

SHEET = "row_index long, table_name string, field_name string, domain_type string, data_example string, field_type string, is_enum string, enum_values string, business_meaning string, business_caliber string"

# The sample rows (table, field, domain type, sample, class, is-enum, enum list, definition) and the rules that each breaks.
A, B, T, L = "客户信息表", "客户信息明细表", "交易流水表", "贷款信息表"
SAMPLES = [
    (A, "客户名称", "anc..(100)", "张三", "文本类", "否", "", "客户名称", ""),
    (A, "开户日期", "DATE", "2000-01-01 00:00:00", "日期时间类", "否", "", "开户的日期", "sample"),
    (A, "手机号码", "VARCHAR(100)", "11111111111", "文本类", "", "", "客户手机号", "required domain"),
    (A, "客户状态", "", "", "代码枚举类", "是", "01-正常;02-冻结;03-注销", "标识客户在系统中的当前状态", "required"),
    (A, "交易金额", "i(19,2)", "11111.1111", "数值类", "否", "", "记录一笔交易的实际发生金额，单位为元", "sample"),
    (A, "第二结论类型", "an..(2)", "通过", "代码枚举类", "是", "01-通过;02-拒绝", "第二结论类型", ""),
    (A, "CDA规则结果", "an..(2)", "01", "代码枚举类", "是", "01-命中;02-未命中", "CDA的规则结果", ""),
    (B, "CDA规则结果", "an..(2)", "01", "代码枚举类", "是", "", "CDA规则结果字段", "enum again"),
    (B, "转案欺诈类型", "an..(2)", "", "代码枚举类", "是", "01-欺诈;02-正常", "指转案欺诈的不同类别", "required again"),
    (B, "CDA规则结果", "an..(2)", "01", "代码枚举类", "是", "01-命中;02-未命中", "规则判定结果，用于自动审批决策", "again"),
    (B, "转案欺诈类型", "an..(2)", "01", "代码枚举类", "是", "", "标记案件转案过程中涉及的欺诈行为分类", "enum again"),
    (B, "", "an!(10)", "", "文本类", "否", "", "记录客户的电子邮箱地址", "required"),
    (B, "证件类型", "an..(2)", "01", "", "是", "身份证;护照;军官证", "标识客户使用的证件类型", "required"),
    (B, "账户余额", "i", "1111.11", "数值类", "是", "", "", "required enum domain"),
    (B, "银行卡号", "an..(5)", "111111111", "编码类", "否", "", "记录客户绑定的银行卡卡号", "sample"),
    (B, "是否VIP", "an..(1)", "是", "布尔型", "否", "", "标识客户是否为VIP用户", "class"),
    (B, "支付方式", "i(1)", "1", "代码枚举类", "是", "1.现金 2.银行卡 3.支票 4.汇款", "记录客户选择的支付方式类型", ""),
    (B, "性别", "an..(1)", "男", "代码枚举类", "是", "男/女", "标识客户的性别信息", ""),
    (B, "信用等级", "an..(1)", "A", "代码枚举类", "是", "(A)优秀 (B)良好 (C)一般 (D)较差", "反映客户的信用评级", ""),
    (B, "币种代码", "an..(10)", "编码", "编码类", "是", "01：人民币 02：美元 03：欧元", "标识交易使用的货币类型代码", "enum sample"),
    (B, "是否冻结", "a..(2)", "Y", "标志类", "是", "Y-是;N-否", "标识账户是否被冻结", ""),
    (B, "交易状态", "", "01", "代码枚举类", "是", "01-成功;02-失败;03-处理中", "记录交易的当前处理状态", "required"),
    (A, "客户编号", "n..(20)", "100001", "编码类", "否", "", "客户在系统中的唯一标识编号", ""),
    (A, "证件号码", "an..(18)", "110101199001011234", "文本类", "否", "", "客户有效身份证件号码", ""),
    (A, "联系地址", "anc..(200)", "北京市朝阳区建国路88号", "文本类", "否", "", "客户常住地址", ""),
    (A, "客户性别", "n!(1)", "1", "代码枚举类", "是", "1-男;2-女", "标识客户性别", ""),
    (T, "交易流水号", "an..(32)", "TX20240115000001", "编码类", "否", "", "交易流水的唯一标识编号", ""),
    (T, "交易金额", "i(19,2)", "1000.50", "数值类", "否", "", "交易实际发生金额", ""),
    (T, "交易日期", "DATE", "20240115", "日期时间类", "否", "", "交易发生的自然日", ""),
    (L, "贷款合同号", "an..(32)", "HT2024010001", "编码类", "否", "", "贷款合同的唯一标识编号", ""),
    (L, "贷款金额", "i(19,2)", "500000.00", "数值类", "否", "", "贷款合同约定的本金金额", ""),
    (L, "贷款状态", "n!(1)", "1", "代码枚举类", "是", "1-正常;2-逾期;3-结清", "贷款当前所处状态", ""),
]
SIGNS = {"required": "必填字段为空", "domain": "域类型'", "sample": "数据示例'", "enum": "'是否枚举'", "again": "中重复", "class": "不合法，必须是"}


def test_sample_rows(spark):
    rows = [(i, *r[:8], "") for i, r in enumerate(SAMPLES)]
    sheet = spark.createDataFrame(rows, SHEET)
    checked = {r.row_index: r.rule_issues for r in quality.check_rules(sheet).collect()}
    for i, r in enumerate(SAMPLES):
        want = r[8].split()
        assert len(checked[i]) == len(want) and all(any(SIGNS[k] in x for x in checked[i]) for k in want), (r, checked[i])
    out = {r.row_index: r for r in jobs.quality_check(sheet, ask_meaning=False).collect()}
    no_codes = {12, 16, 17}
    assert {i for i, r in out.items() if r.check_result == "通过"} == {i for i, r in enumerate(SAMPLES) if not r[8]} - no_codes
    assert all("枚举值缺少代码" in out[i].fail_reason for i in no_codes) and out[18].enum_values == "A-优秀;B-良好;C-一般;D-较差"
    assert tuple(report.quality_summary(spark.createDataFrame(list(out.values()))).first()) == (32, 15, 17, 0)


def test_the_oracle_states_the_library_s_values():
    assert {k: v[1:] for k, v in BAD_CHARACTER.items()} == sql.BAD_CHARACTER
    assert {k: set(v) for k, v in WHITELIST.items()} == {k: set(v) for k, v in sql.WHITELIST.items()}


def test_written_indicator_cases(spark):
    cases = [("非标资产-资产期限1年以上-加权投资收益率", "", False), ("近60天交易笔数", "取清算流水表，判断交易金额大于0，并且交易创建时间大于当前会计日减60天", True), ("贷款金额", "", False), (None, "统计", False)]
    df = spark.createDataFrame(cases, "n string, c string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", names.is_indicator("n", "c")).collect())


# --- scorers


def sent(spark, n=30):
    return spark.range(n).select(F.col("id").alias("row_index"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("kind")).coalesce(1)


def broken():
    def score(pdf):
        if 15 in set(pdf["row_index"]):
            raise ValueError("no answer")
        return pdf[["row_index"]].assign(is_valid=True, reasoning="", extra=1)

    return score


@pytest.mark.parametrize(("policy", "want"), [("missing", {"ok": 20, "missing": 10}), ("mark", {"ok": 20, "failed": 10})])
def test_a_failed_call_is_judged_by_policy(spark, policy, want):
    s = sent(spark)
    got = scoring.reconcile(s, scoring.run_scorer(s, broken(), scoring.RESULTS["sample"], on_error=policy).withColumn("arrival", F.lit(0)))
    assert {r.status: r["count"] for r in got.groupBy("status").count().collect()} == want
    assert got.where("status = 'failed'").where("call_failed != 'ValueError: no answer'").count() == 0


def test_a_failed_call_fails_the_job_by_default(spark):
    s = sent(spark)
    with pytest.raises(Exception, match="no answer"):
        scoring.run_scorer(s, broken(), scoring.RESULTS["sample"]).collect()


def test_batches_of_a_call_are_of_one_class(spark):
    def score(pdf):
        assert pdf["kind"].nunique() == 1 and len(pdf) <= 4
        return pdf[["row_index"]].assign(is_valid=True, reasoning=f"{len(pdf)}")

    rows = scoring.run_scorer(sent(spark), score, scoring.RESULTS["sample"], 4, by="kind").collect()
    assert sorted(r.row_index for r in rows) == list(range(30)) and {r.reasoning for r in rows} == {"4", "2"}


def test_duplicates_and_unknown_rows(spark):
    s = sent(spark, 4).select("row_index")
    got = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "c", 1), (9, "d", 1)], "row_index long, verdict string, arrival long")
    assert sorted(tuple(r) for r in scoring.reconcile(s, got).collect()) == [(0, "b", "duplicate"), (1, "c", "ok"), (2, None, "missing"), (3, None, "missing")]


def test_embedder_gets_each_text_once_and_gives_unit_vectors(spark):
    def embed(texts):
        assert len(texts) <= 32 and len(set(texts)) == len(texts)
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(200)] + [(500, None)], "i int, t string").coalesce(1)
    rows = scoring.embed_distinct(df, "t", embed).collect()
    assert len(rows) == 201
    for r in rows:
        n = len(r.t or "")
        assert r.vector is None if n == 0 else np.allclose(r.vector, np.array([n, 1]) / math.hypot(n, 1), atol=1e-6)


def test_rows_are_numbered_within_classes(spark):
    df = spark.range(5000).select((4999 - F.col("id")).alias("k"), F.when(F.col("id") % 7 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, "rare").alias("c")).repartition(7)
    seen: dict = {}
    for r in sorted(tables.number_rows(df, "k", "n", ["c"]).collect(), key=lambda r: r.k):
        seen[r.c] = seen.get(r.c, 0) + 1
        assert r.n == seen[r.c]
    assert sorted((r.k, r.n) for r in tables.number_rows(df, "k", "n").collect()) == [(k, k + 1) for k in range(5000)]


# --- retrieval in blocks


def test_bm25_in_blocks_equals_one_block(spark, sf):
    d, q = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = sorted(tuple(r) for r in retrieve.bm25(q, d, 5, "item_id", "doc_id").select("item_id", "rank", "doc_id").collect())
    small = sorted(tuple(r) for r in retrieve.bm25(q, d, 5, "item_id", "doc_id", query_rows=3, block_postings=2000).select("item_id", "rank", "doc_id").collect())
    assert plain == small and len(plain) > 20


# --- mapping


WORD = re.compile("[a-z0-9à-öø-ÿœß]+|[一-鿿]+")


def tokens(text):
    out = []
    for w in WORD.findall(text.lower()):
        out += [w] if not "一" <= w[0] <= "鿿" or len(w) == 1 else [w[i:i + 2] for i in range(len(w) - 1)]
    return out


def bm25(query, docs):
    lens = {i: len(tokens(t)) for i, t in docs.items()}
    avg, out = sum(lens.values()) / len(lens), {}
    for w in set(tokens(query)):
        having = {i: tokens(t).count(w) for i, t in docs.items() if w in tokens(t)}
        idf = math.log(1 + (len(docs) - len(having) + 0.5) / (len(having) + 0.5))
        for i, tf in having.items():
            out[i] = out.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[i] / avg))
    return out


FIELDS = [  # name, class, sample, caliber, definition
    ("客户编号", "编码类", "12345", "", "客户的唯一编号"), ("客户编号", "编码类", "12345", "", "客户的唯一编号"), ("开户时间", "日期时间类", "2024-01-05", "", "开户的日期"),
    ("近60天交易笔数", "数值类", "5", "取流水表，统计近60天", "交易的笔数"), ("交易金额", "数值类", "12.50", "", "交易的金额"), ("是否冻结", "标志类", "客户", "", "账户是否冻结"), ("没有标准的文本", "文本类", "", "", "无"), ("性别", "代码枚举类", "1", "", "性别"),
]
STANDARDS = [  # id, name, class, definition, domain type
    ("S1", "客户编号", "编码类", "客户的唯一标识", "n..(10)"), ("S2", "机构编号", "编码类", "机构的编号", "n..(3)"), ("S3", "客户号", "编码类", "客户的号码", ""), ("S4", "开户日期", "日期时间类", "账户开户的日期", "DATE"),
    ("S5", "交易时间", "日期时间类", "交易的时间", "TIME"), ("S6", "交易金额", "数值类", "一笔交易的金额", "i(8,2)"), ("S7", "交易笔数", "数值类", "交易的笔数", "i(3)"), ("S8", "冻结标志", "标志类", "账户是否冻结", "n!(1)"), ("S9", "旧名", "数值类", "旧定义", ""),
    ("S9", "账户金额", "数值类", "账户的金额", "i(4)"),
]


def plain_mapping(k):
    embed = scoring.hashing_embedder(64)
    unit = lambda t: (v := embed([t])[0].astype(float)) / np.linalg.norm(v)
    last = {s[0]: s for s in STANDARDS}
    out = {}
    for row, (name, cls, sample, _, meaning) in enumerate(FIELDS):
        if cls == "代码枚举类" or row == 3:  # enum fields and the statistic
            continue
        name = "开户日期" if name == "开户时间" else name
        variants = [name] + ([name[:-2] + "号"] if name.endswith("编号") else [name[:-1] + "编号"] if name.endswith("号") else [])
        own = {i: s for i, s in last.items() if s[2] == cls}
        merged: dict = {}
        for n, v in enumerate(variants):
            best = lambda score, m: sorted((i for i in score), key=lambda i: (-round(score[i], 9), i))[:m]
            dn, dm = ({i: float(unit(q) @ unit(s[f])) for i, s in own.items()} for q, f in ((v, 1), (meaning, 3)))
            both = {i: 0.6 * dn[i] + 0.4 * dm[i] for i in own}
            paths = [("dense", best(both, k), both)]
            paths += [(p, best(sc, k), sc) for p, sc in (("name_sparse", bm25(v, {i: s[1] for i, s in own.items()}) if own else {}), ("meaning_sparse", bm25(meaning, {i: s[3] for i, s in own.items()}) if own else {}))]
            first = {}
            for at, (_, ids, _) in enumerate(paths):
                for r, i in enumerate(ids):
                    first.setdefault(i, (at, r))
            for place, i in enumerate(sorted(first, key=first.get)):
                merged.setdefault(i, (n, place))
        listed = sorted(merged, key=lambda i: (merged[i], i))
        gone = [i for i in listed if cls != "标志类" and sample and not fits(sample, last[i][4])]
        out[row] = ([i for i in listed if i not in gone], gone, listed)
    return out


def fits(sample, domain):
    digits = re.sub("[-:/ T]", "", sample)
    if domain.startswith("n"):
        n = int(re.search(r"\d+", domain)[0])
        return sample.isdigit() and (len(sample) <= n if ".." in domain else len(sample) == n)
    if domain.startswith("i"):
        x, _, y = domain[2:-1].partition(",")
        whole, dot, frac = sample.partition(".")
        return bool(re.fullmatch("[0-9+.-]*", sample)) and 0 < len(whole) <= int(x) and (len(frac) <= int(y) if y else not dot)
    if domain == "DATE":
        return bool(re.fullmatch("[0-9:/ T-]*", sample)) and 6 <= len(digits) <= 8
    return domain == "" or (domain == "TIME" and bool(re.fullmatch("[0-9:/ T.-]*", sample)) and 3 <= len(digits) <= 6)


@pytest.fixture(scope="module")
def mapping_tables(spark):
    sheet = spark.createDataFrame([(i, "表", f[0], "", f[2], f[1], "", "", f[4], f[3]) for i, f in enumerate(FIELDS)], SHEET)
    std = spark.createDataFrame([(p, s[0], s[1], s[2], s[3], "D", "d", s[4], "", "") for p, s in enumerate(STANDARDS)], "pos long, std_id string, std_name string, std_type string, definition string, domain_id string, domain_name string, domain_type string, enum_id string, rule string")
    return sheet, std


def test_standard_mapping_equals_plain_python(spark, mapping_tables):
    sheet, std = mapping_tables

    def select(pdf):
        assert pdf["field_type"].nunique() == 1
        c = pdf["candidates"].map(lambda x: x[0])
        return pdf[["row_index"]].assign(selection="复用已有标准", selected_std_id=c.map(lambda x: x["std_id"]), selected_std_name=c.map(lambda x: x["std_name"]), reasoning="first")

    got = {r.row_index: r for r in jobs.standard_mapping(sheet, std, scoring.hashing_embedder(64), select, k=2).collect()}
    want = plain_mapping(2)
    last = {s[0]: s[1] for s in STANDARDS}
    assert len(got) == len(FIELDS)
    for row in range(len(FIELDS)):
        if row not in want:
            assert (got[row].mapping_result, got[row].candidates) == ("", "")
            continue
        kept, gone, listed = want[row]
        assert got[row].candidates == "\n".join(f"{i} {last[i]}" for i in kept), (row, kept, gone)
        if kept:
            assert (got[row].mapping_result, got[row].selected_std_id, got[row].llm_reason) == ("复用已有标准", kept[0], "first")
            assert all(i in got[row].domain_check_details for i in listed) or FIELDS[row][1] == "标志类"
        else:
            assert got[row].mapping_result == "新增标准" and "直接新增标准" in got[row].llm_reason
    assert any(gone for _, gone, _ in want.values()) and got[5].domain_check_details == "标志类字段，域类型恒定通过"
    assert tuple(report.mapping_summary(spark.createDataFrame(list(got.values()))).first()) == (6, 5, 1, 0, 0)


def test_mapping_policies(spark, mapping_tables):
    sheet, std = mapping_tables

    def rename(pdf):
        if (pdf["field_name"] == "开户时间").any():
            raise ValueError("down")
        return pdf[["row_index"]].assign(rewritten_field_name="冻结标志", rewritten_business_meaning="", reasoning="")

    def numeric(pdf):
        return pdf[["row_index"]].iloc[:1].assign(is_indicator=pdf["field_name"].iloc[0] == "交易金额", reasoning="")

    flags = sheet.withColumn("enum_values", F.when(F.col("row_index") == 5, "1-冻结;0-正常").otherwise(""))
    bad = spark.createDataFrame([(0, "timeout")], "row_index long, fetch_error string")
    got = {r.row_index: r for r in jobs.standard_mapping(flags, std, scoring.hashing_embedder(64), None, k=2, numeric=numeric, datetime_rename=rename, flag_rename=rename, fetch_errors=bad).collect()}
    assert (got[0].mapping_result, got[0].llm_reason) == ("候选检索失败，需人工复核", "timeout") and got[1].mapping_result == "LLM未返回该行结果，需人工复核"
    assert got[2].candidates != "" and got[3].mapping_result != ""  # a failed rename keeps the name, a missing answer keeps the row
    with pytest.raises(Exception, match="down"):
        jobs.standard_mapping(sheet, std, scoring.hashing_embedder(64), lambda pdf: rename(pdf.assign(field_name="开户时间")), k=2).collect()


# --- enum mapping


def test_greedy_example(spark):
    """A takes C, its best, and D stays free for B, whose best is taken."""
    pairs = spark.createDataFrame([(1, 0, "1", "A"), (1, 1, "2", "B")], "row_index long, pos int, code string, value string")
    hits = spark.createDataFrame([("A", "X", "C", 0.9, 1), ("A", "X", "D", 0.85, 2), ("B", "X", "C", 0.95, 1), ("B", "X", "D", 0.9, 2), ("B", "X", "E", 0.8, 3)], "value string, item_id string, value_text string, score double, hit_pos int")
    got = enummap.greedy_scores(pairs, hits).first()
    assert got.score == 2 and [m.value for m in got.matched] == ["A", "B"]
    one = enummap.greedy_scores(pairs, hits.where("value_text = 'C'")).first()
    assert one.score == 1 and [m.value for m in one.matched] == ["A"]


def test_enum_mapping(spark):
    std = spark.createDataFrame(
        [(1, "T1", "性别代码", "代码枚举类", "性别", "E1", "1-男;2-女"), (2, "T2", "性别二", "代码枚举类", "性别二", "E1", ""), (3, "T3", "状态代码", "代码枚举类", "状态", "E2", "1-正常;2-冻结;3-注销")],
        "pos long, std_id string, std_name string, std_type string, definition string, enum_id string, rule string",
    )
    lists = ["1-男;2-女", "1-正常;2-冻结;3-注销;4-新开", "1-全新;2-未知", "1-男;2-女", "1-女;2-男", "", "1-女;2-男"]
    sheet = spark.createDataFrame([(i, "表", f"字段{i}", "", "", "代码枚举类", "是", e, "", "") for i, e in enumerate(lists)], SHEET)

    def select(pdf):
        out = pdf[["row_index"]].assign(selection="复用已有标准", selected_std_id=[c[0]["std_id"] for c in pdf["candidates"]], selected_std_name="n", reasoning="r")
        out.loc[out["row_index"] == 3, "selected_std_id"] = "T9"
        if 4 in set(pdf["row_index"]):
            raise ValueError("down")
        return out

    one = lambda pdf: __import__("pandas").concat([select(pdf.iloc[i:i + 1]) for i in range(len(pdf))]) if 4 not in set(pdf["row_index"]) else select(pdf)
    spread = sheet.repartition(7, "row_index")
    got = {r.row_index: r for r in jobs.enum_mapping(spread, std, scoring.hashing_embedder(64), one, fetch_errors=spark.createDataFrame([(6, "timeout")], "row_index long, fetch_error string"), checkpoint=lambda df: df).collect()}
    assert (got[1].mapping_result, got[1].selected_std_id, got[1].enum_code_suggestion) in (("修改枚举代码+复用已有标准", "T3", "向枚举代码E2补充: 4-新开"), ("LLM判断失败", "", ""))
    assert got[2].mapping_result == "新增枚举代码新增标准" and got[2].candidates == "" and "无候选" in got[2].llm_reason
    assert (got[4].mapping_result, got[4].llm_reason) == ("LLM判断失败", "LLM 调用失败（重试后仍失败）: ValueError: down") and got[4].candidates == "E1 性别代码(得分2/n,复用,标准T1+T2)"
    assert got[5].mapping_result == "" and (got[6].mapping_result, got[6].llm_reason) == ("候选检索失败，需人工复核", "timeout")
    calm = {r.row_index: r for r in jobs.enum_mapping(sheet.where("row_index not in (4, 6)"), std, scoring.hashing_embedder(64), one).collect()}
    assert (calm[0].mapping_result, calm[0].selected_std_id, calm[0].enum_code_suggestion) == ("复用枚举代码+复用已有标准", "T1", "")
    assert (calm[1].mapping_result, calm[1].selected_std_id, calm[1].enum_code_suggestion) == ("修改枚举代码+复用已有标准", "T3", "向枚举代码E2补充: 4-新开")
    assert calm[3].mapping_result == "LLM返回异常结果，需人工复核" and "T9 不在召回候选内" in calm[3].llm_reason
    assert tuple(report.enum_summary(spark.createDataFrame(list(calm.values()))).first()) == (4, 1, 1, 1, 1)


def test_enum_candidates_are_kept_once_a_list(spark, tmp_path):
    """A code that 150 standards cite, and 400 fields with its list: their product is asked for and told, but never kept."""
    std = spark.createDataFrame(
        [(n, f"T{n:03d}", f"性别代码{n}", "代码枚举类", "性别", "E1", "1-男;2-女") for n in range(150)],
        "pos long, std_id string, std_name string, std_type string, definition string, enum_id string, rule string",
    )
    sheet = spark.createDataFrame([(i, "表", f"字段{i}", "", "", "代码枚举类", "是", "1-男;2-女" if i % 2 else "1-女;2-男", "", "") for i in range(400)], SHEET)
    held, kept = [], tables.kept

    def measured(df):
        out = kept(df)
        held.append(out.select(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns]))))).first()[0] or 0)
        return out

    def last(pdf):
        assert len(pdf) <= 5 and list(pdf.columns) == ["row_index", "field_name", "field_type", "business_meaning", "candidates"]
        assert all([x["std_id"] for x in c] == [f"T{n:03d}" for n in range(150)] for c in pdf["candidates"])
        return pdf[["row_index"]].assign(selection="复用已有标准", selected_std_id=[c[-1]["std_id"] for c in pdf["candidates"]], selected_std_name="n", reasoning=pdf["field_name"])

    calls = scoring.Calls(log=f"file://{tmp_path}/log")
    got = jobs.enum_mapping(sheet, std, scoring.hashing_embedder(64), last, checkpoint=measured, calls=calls)
    rows = got.collect()
    assert len(rows) == 400 and all(r.selected_std_id == "T149" and r.llm_reason == r.field_name and r.candidates.count("+T") == 149 for r in rows)
    assert sum(held) < 1_000_000  # 400 x 150 standards are over 4 million characters
    used = calls.usage().agg(F.sum("n_rows")).first()[0]
    again = scoring.Calls(log=f"file://{tmp_path}/log")
    assert used == 400 and jobs.enum_mapping(sheet, std, scoring.hashing_embedder(64), last, calls=again).exceptAll(got).count() == 0
    assert again.usage().count() == 0


# --- maintenance


def test_maintenance(spark):
    sheet = spark.createDataFrame([(i, "表", f"字段{i}KEY值5", "", "", "文本类", "否", "", f"原{i}", "") for i in range(5)], SHEET).coalesce(1)

    def name(pdf):
        return pdf[["row_index"]].assign(normalized_name=pdf["field_name"].str[:3], changed=pdf["row_index"] != 1, reasoning="").iloc[:4]

    def definition(pdf):
        return pdf[["row_index"]].assign(business_meaning=["定义" if i != 2 else " " for i in pdf["row_index"]], reasoning="").query("row_index != 3")

    def merge(pdf):
        raise RuntimeError("down")

    rows = {r.row_index: r for r in jobs.standard_maintenance(sheet, name, definition, lambda pdf: pdf[["row_index"]].assign(merged_meaning="合并", changed=True, reasoning="")).collect()}
    assert [rows[i].field_name for i in range(5)] == ["字段0", "字段1KEY值5", "字段2", "字段3", "字段4KEY值5"]
    assert [rows[i].business_meaning for i in range(5)] == ["合并", "合并", "", "", "合并"]
    assert (rows[2].definition_reason, rows[3].definition_reason, rows[0].definition_reason) == ("LLM 返回空定义，需人工复核", "LLM 调用成功但该行结果缺失/重复，需人工复核", "")
    failed = {r.row_index: r for r in jobs.standard_maintenance(sheet, merge, definition, merge).collect()}
    assert failed[0].field_name == "字段0KEY值5" and (failed[0].business_meaning, failed[0].definition_reason) == ("", "LLM 调用失败: RuntimeError: down") and failed[2].definition_reason == "LLM 返回空定义，需人工复核"


def test_soft_checks_say_that_they_did_not_run(spark):
    sheet = spark.createDataFrame([(0, "表", "客户名", "anc..(9)", "张三", "文本类", "否", "", "客户的名字", "")], SHEET)

    def down(pdf):
        raise RuntimeError("down")

    row = jobs.quality_check(sheet, meaning=down, class_check=down, sample=down).first()
    assert row.check_result == "不通过" and "LLM未返回该行结果，业务含义检查需人工复核" in row.fail_reason
    row = jobs.quality_check(sheet, class_check=down, sample=down, ask_meaning=False).first()
    assert row.check_result == "通过" and row.soft_check_result == "1. LLM字段所属类型检查未执行，需人工复核\n2. LLM数据示例语义检查未执行，需人工复核"
