"""Rules, sources, sinks, generation and masking on small inputs."""

import json
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quillmask.functions import keyed, temporal, text
from quillmask.operators import actions, coverage, detect, generate, profile, quality, relationships
from quillmask.operators.actions import Policy
from quillmask.plans.masking import mask, report
from quillmask.sources import delimited, sinks


def one(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_text_functions(spark):
    assert one(spark, ["ABC", "abc", "Abc Def", "aBC", "12", None], text.case_pattern) == ["UPPER", "LOWER", "TITLE", "MIXED", "NO_CASE", "NO_CASE"]
    assert one(spark, ["$1,234.50", "12%", "AUD 7", "1,2", "x", None], text.number) == [1234.5, 12.0, 7.0, None, None, None]
    assert one(spark, ["(12.5)", "€3", "-4"], text.business_number) == [-12.5, 3.0, -4.0]
    assert one(spark, ["=1", "-5", "-x", " @a", "'=x", None], text.excel_safe) == ["'=1", "-5", "'-x", "' @a", "'=x", ""]
    assert one(spark, ["51 824 753 556", "51 824 753 557", None], lambda c: text.au_identifier_valid(c, "ABN")) == [True, False, False]
    assert one(spark, ["", "  ", None, "　", "x"], text.is_empty) == [True, True, True, True, False]


def test_temporal(spark):
    assert one(spark, ["2024-02-28", "2023-02-30", "x"], lambda c: temporal.shifted_date(c, 2)) == ["2024-03-01", "2023-02-30", "x"]
    assert one(spark, ["11:50 PM", "0:05"], lambda c: temporal.shifted_time(c, 20)) == ["12:10 AM", "0:25"]
    assert one(spark, ["A-007", "A-999", "none"], lambda c: temporal.shifted_segment(c, 5)) == ["A-012", None, "none"]
    assert temporal.inferred_layout(1, 0) == "DMY" and temporal.inferred_layout(1, 1) == "AMBIGUOUS"


def test_keyed_randomness_ignores_partitioning(spark):
    df = spark.range(500)
    draw = lambda d: {r[0]: r[1] for r in d.select("id", keyed.uniform(3, "x", F.col("id"))).collect()}
    a = draw(df.repartition(7))
    assert a == draw(df.coalesce(1)) and 0.4 < sum(a.values()) / 500 < 0.6


def col(name, samples, **kw):
    n = len(samples)
    return detect.Column(name, **({"observed": n, "non_empty": n, "distinct": len(set(samples)), "unique_ratio": len(set(samples)) / max(1, n), "max_length": max(map(len, samples), default=0), "samples": samples} | kw))


@pytest.mark.parametrize(
    ("name", "samples", "kind"),
    [
        ("contact", ["a@b.co", "c@d.org"], "EMAIL"), ("mobile", ["0400 123 456", "0411 222 333"], "PHONE_LIKE"), ("due", ["2024-01-02", "2024-03-04"], "DATE"), ("due", ["13/01/2024", "02/03/2024"], "DATE"),
        ("due", ["01/02/2024", "02/03/2024"], "AMBIGUOUS_DATE"), ("at", ["10:30", "23:59"], "TIME"), ("flag", ["yes", "no"], "BOOLEAN"), ("code", ["AB-12", "CD-34", "EF-56"], "ALPHANUMERIC_CODE"), ("account_no", ["00123", "00456"], "NUMERIC_ID"),
        ("amount", ["1.50", "2.25"], "DECIMAL"), ("rate", ["5%", "7%"], "PERCENTAGE"), ("price", ["$5", "$7"], "CURRENCY_LIKE"), ("abn", ["51824753556"], "AU_ABN"), ("full_name", ["Ann Lee", "Bo Chan"], "NAME_LIKE"),
        ("notes", ["It broke. We fixed it.", "Fine."], "FREE_TEXT"), ("empty", [], "EMPTY"), ("thing", ["alpha", "beta"], "GENERAL_TEXT"),
    ],
)
def test_detection(name, samples, kind):
    assert detect.detected(col(name, samples)).type == kind


def test_risk_role_and_action():
    c = col("email", [f"u{i}@x.io" for i in range(30)])
    d = detect.detected(c)
    level = detect.risk_level(detect.risks(c, d))
    assert (level, detect.role(c, d, level), detect.recommended(c, d, level, "DIRECT_IDENTIFIER")) == ("HIGH", "DIRECT_IDENTIFIER", "REPLACE")
    salary = col("salary", [str(1000 + i % 5) for i in range(60)])
    d = detect.detected(salary)
    assert detect.role(salary, d, "LOW") == "SENSITIVE_ATTRIBUTE"
    with pytest.raises(ValueError):
        Policy("d", "SHIFT")


def test_profile_and_mask(spark):
    df = spark.createDataFrame([(f"user{i}@x.io", f"2024-01-{i % 28 + 1:02d}", str(i % 3), None if i % 5 else "note 123456789") for i in range(60)], "email string, joined_date string, band string, note string")
    p = {r["column_name"]: r for r in profile.column_profiles(df).collect()}
    assert (p["note"]["empty"], p["band"]["distinct"], p["band"]["quantiles"][3]) == (48, 3, 1.0)
    plan = [Policy("email", "REPLACE", "EMAIL", "DIRECT_IDENTIFIER"), Policy("joined_date", "SHIFT", "DATE", params={"offset": 3}), Policy("band", "RESAMPLE", "CATEGORY"), Policy("note", "TEXT_SANITISE")]
    out = mask(df, plan)
    rows = out.collect()
    assert all(r.email.endswith("@example.invalid") for r in rows) and len({r.email for r in rows}) == 60
    assert {r.band for r in rows} == {"0", "1", "2"} and {r.note for r in rows} == {"", "note [PHONE_OR_NUMBER]"}
    assert sorted(rows) == sorted(mask(df.repartition(5), plan).collect())
    said = report(df, out, plan)
    assert said["overall"] in ("PASS", "REVIEW") and set(said["zones"]) == set(quality.ZONES)
    with pytest.raises(ValueError):
        actions.transformed(df, plan[:2])


def test_relationships(spark):
    rules = relationships.proposed(["status_code", "status_description", "start_date", "end_date"])
    assert {r.kind for r in rules} >= {"CODE_DESCRIPTION", "DATE_ORDER"}
    df = spark.createDataFrame([(i, str(i), str(2 * i)) for i in range(1, 40)], "id long, a string, b string")
    found = relationships.mined(df, ["a", "b"], order=F.col("id"))
    assert [(r.kind, r.options["constant"]) for r in found] == [("NUMERIC_RATIO", 2.0)]
    broken = df.withColumn("b", F.when(F.col("id") == 7, "0").otherwise(F.col("b")))
    assert relationships.rule_violations(broken, found[0]).first()["violations"] == 1


def test_coverage():
    rows = [("r1", ["a", "b"]), ("r2", ["c"]), ("r3", ["a"])]
    assert coverage.cover(rows, {"a": 5, "b": 1, "c": 9}, 2) == ["r2", "r1"]
    assert coverage.allocated_uses([3, 1], 10) == [7, 3] and sum(coverage.allocated_uses([1, 1, 1], 100)) == 100
    assert coverage.systematic_indexes(100, 4) == [0, 25, 50, 75]
    low, high = coverage.count_interval(50, 100, 20)
    assert 0 < low < 10 < high < 20


def test_generation(spark):
    t = generate.generated(spark, generate.connected_scenario(60, 10))
    assert t["people"].count() == 60 and t["orders"].count() > 0
    assert t["orders"].select("order_id").distinct().count() == t["orders"].count()
    late = t["orders"].join(t["people"].select("person_id", "joined_date"), "person_id").where("order_date < joined_date")
    assert late.count() == 0
    nulls = generate.Table("n", (generate.Field("x", "integer", null_rate=0.25),), 40)
    assert generate.generated(spark, [nulls])["n"].where("x = ''").count() == 10
    with pytest.raises(ValueError):
        generate.validate([generate.Table("a", (generate.Field("b", "foreign-key", {"table": "zzz"}),))])
    with pytest.raises(ValueError):
        generate.in_order({"a": {"b"}, "b": {"a"}}, "tables")


def test_delimited(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_bytes(b"\xef\xbb\xbfid;name;amount\n1;\"a;b\";2.5\n\n2;c;3;extra\n\n\n")
    df, said = delimited.read_delimited(spark, str(f), faithful=True)
    assert (said["delimiter"].value, said["has_header"], said["columns"][:3]) == (";", True, ["id", "name", "amount"])
    rows = df.orderBy("_row").collect()
    assert [r["name"] for r in rows] == ["a;b", "", "c"]
    assert delimited.parse_issues(df, 3).where("row = 3").count() == 1
    plain, _ = delimited.read_delimited(spark, str(f))
    assert plain.count() == 2
    assert delimited.detect_delimiter("a\tb\n1\t2\n3\t4\n").value == "\t"
    assert delimited.detect_header([["1", "2"], ["3", "4"]]).value == "no"
    assert delimited.encoding_of(b"\xff\xfea\0") == "utf-16le"
    assert delimited.size_class(200 << 20) == "VERY_LARGE"
    with pytest.raises(ValueError):
        delimited.check_delimiter('"')


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1", 'say "hi"')], "a string, b string")
    assert sinks.csv_text(df) == '﻿a,b\r\n\'=1,"say ""hi"""\r\n'
    z = zipfile.ZipFile(BytesIO(sinks.archive({"t": df})))
    assert json.loads(z.read("manifest.json"))["tables"] == {"t": 1}
    policies, more = sinks.config_from(sinks.config_text([Policy("a", "CLEAR")], seed=3))
    assert policies[0].action == "CLEAR" and more == {"seed": 3}
    sinks.write_delimited(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()["b"] == 'say "hi"'


def test_stream(spark, tmp_path, data):
    from quillmask.streaming.chunks import each_chunk, masked_stream

    df = spark.read.parquet(f"{data}/nation.parquet")
    df.write.parquet(str(tmp_path / "in"))
    plan = [Policy("n_nationkey"), Policy("n_name", "REPLACE", "NAME_LIKE"), Policy("n_regionkey", "CLEAR")]
    seen = []
    each_chunk(spark, str(tmp_path / "in"), df.schema, lambda batch, i: seen.extend(masked_stream(batch, plan).collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == sorted(actions.transformed(df, plan).collect())


def test_floating_point_numbers_are_digits(spark):
    df = spark.createDataFrame([(5.0,), (12345678.9,), (0.0001,), (98765432.0,), (-1.5e-9,), (1e22,), (None,)], "x double")
    p = profile.column_profiles(df).first()
    assert (p["numeric_count"], p["maximum"], p["minimum"]) == (6, 1e22, -1.5e-9)
    assert [r[0] for r in df.select(text.plain(F.col("x"))).collect()] == ["5.0", "12345678.9", "0.0001", "98765432", "-0.0000000015", "10000000000000000000000", None]
    assert detect.analysed(df.where("x > 0 and x < 1e9"))[0][1].type in ("DECIMAL", "NUMERIC_ID")


def test_profiles_are_exact_however_many_values(spark):
    n = 1_500_000  # more than are counted with other columns
    p = profile.column_profiles(spark.range(n).select((F.col("id") * 2).alias("x"))).first()
    assert (p["distinct_status"], p["quantile_status"], p["distinct"], p["observed"], p["minimum"], p["maximum"]) == ("EXACT", "EXACT", n, n, 0.0, 2.0 * (n - 1))
    assert p["quantiles"] == pytest.approx([2 * q * (n - 1) for q in profile.QUANTILES], rel=1e-12)


def test_wide_columns_are_profiled_like_others(spark):
    x = F.col("id") % 997
    df = spark.range(3000).select((x / 7 - 40).alias("a"), F.when(x % 5 == 0, F.concat(F.lit(" $"), x.cast("string"))).when(x % 5 == 1, F.concat(x.cast("string"), F.lit(".0"))).when(x % 5 == 2, "Word").when(x % 5 == 3, "").otherwise(x.cast("string")).alias("b"), F.concat(F.lit("t"), x.cast("string")).alias("c"), (-F.col("id") % 2 * 0.0).alias("d"))
    exact = [r.asDict() for r in profile.column_profiles(df).orderBy("column_index").collect()]
    wide = [r.asDict() for r in profile.column_profiles(df, limits=profile.Limits(wide_values=1)).orderBy("column_index").collect()]
    for a, b in zip(exact, wide, strict=True):
        close = ("mean", "quantiles")
        assert {k: v for k, v in a.items() if k not in close} == {k: v for k, v in b.items() if k not in close}
        assert all(a[k] == b[k] or a[k] == pytest.approx(b[k], rel=1e-12) for k in close)


def test_resampling_draws_from_all_values(spark):
    from quillmask.operators import resample

    df = spark.range(5000).select(F.col("id"), (F.col("id") * 3).cast("string").alias("x"), F.when(F.col("id") % 50 == 0, "N/A").otherwise(F.concat(F.lit("$"), (F.col("id") / 4).cast("decimal(10,2)"))).alias("c"))
    out = actions.transformed(df, [Policy("id"), Policy("x", "RESAMPLE", "INTEGER"), Policy("c", "RESAMPLE", "CURRENCY_LIKE")]).collect()
    x = [int(r.x) for r in out]
    assert len(out) == 5000 and len(set(x)) > 4000 and max(x) > 14000 and min(x) < 1000 and 7000 < sum(x) / 5000 < 8000
    assert sum(r.c == "N/A" for r in out) == 100 and all(r.c == "N/A" or r.c.startswith("$") and 0 <= float(r.c[1:]) <= 1249.75 for r in out)
    n = 40
    strata = spark.range(n).select(resample.stratified_share(F.col("id"), n, 3, "s", True)).collect()
    assert sorted(int(r[0] * n) for r in strata) == list(range(n)) and min(r[0] for r in strata) == 0
    form = resample.NumberFormat("INTEGER", digits=5, low=-7.0, high=900.0)
    assert one(spark, ["-2.5", "12.5", "5000"], lambda c: form.written(c.cast("double"), 1, "s")) == ["-00002", "00013", "00900"]


def test_extremes_keep_their_decimal_places(spark):
    from quillmask.operators.resample import stratified_share

    n = 300
    df = spark.range(n).select("id", F.when(F.col("id") == 7, "-994.28").when(F.col("id") == 9, "812.375").otherwise(F.concat(F.col("id").cast("string"), F.lit(".5"))).alias("x"))
    for seed in range(3):
        share = stratified_share(F.col("id"), n, seed, "x", True)
        out = actions.transformed(df, [Policy("id"), Policy("x", "RESAMPLE", "DECIMAL")], F.col("id"), seed=seed, shares={"x": share}).collect()
        x = sorted((r.x for r in out), key=float)
        assert len(out) == n and (x[0], x[-1]) == ("-994.28", "812.375")
        assert sum(len(v.split(".")[1]) == 1 for v in x) > 0.95 * n


def test_month_names_and_layouts(spark):
    v = ["12 Mar 2024", "31-DEC-99", "March 5, 2024", "2024-02-30", "1/2/2024", "13/2/2024"]
    assert one(spark, v, temporal.layout_of) == ["DNY", "DNY", "NDY", None, "AMBIGUOUS", "DMY"]
    assert one(spark, v[:2], lambda c: temporal.shifted_date(c, 1, "DNY")) == ["13 Mar 2024", "01-JAN-00"]
    assert one(spark, ["10.30 pm", "23:59:59Z", "12:30abc"], lambda c: temporal.shifted_time(c, 45)) == ["11.15 pm", "00:44:59Z", "12:30abc"]


@pytest.mark.parametrize(("level", "n"), [("HIGH", 150), ("BALANCED", 60), ("FLEXIBLE", 400)])
def test_lifecycle(spark, data, level, n):
    from quillmask.plans.masking import Fidelity, generate_output, may_export, report, report_json

    c = spark.read.parquet(f"{data}/customer.parquet").withColumn("rid", F.col("c_custkey"))
    plan = [Policy("c_custkey", "PATTERN_REPLACE", "NUMERIC_ID"), Policy("c_name", "REPLACE", "NAME_LIKE", "DIRECT_IDENTIFIER"), Policy("c_nationkey", "RESAMPLE", "INTEGER"), Policy("c_acctbal", "RESAMPLE", "DECIMAL"), Policy("c_mktsegment", "KEEP", "CATEGORY")]
    out, issues = generate_output(c, "rid", plan, n, fidelity=Fidelity(level))
    assert out.count() == n and issues.where("severity = 'ERROR'").isEmpty()
    if level == "BALANCED":
        count = lambda d: {r[0]: r[1] for r in d.groupBy("c_mktsegment").count().collect()}
        there, here = count(c), count(out)
        assert all(abs(here.get(k, 0) - 0.4 * v) <= 2 for k, v in there.items())
    if level == "HIGH":
        said = report(c.drop("rid"), out, plan)
        assert said["zones"]["fidelity"] in ("PASS", "REVIEW") and json.loads(report_json(said)) and may_export(said)[0]
        with pytest.raises(ValueError):
            generate_output(c, "rid", plan, n - 1, fidelity=Fidelity("HIGH"))


def test_rows_that_fail_are_made_anew(spark):
    from quillmask.plans.masking import generate_output

    df = spark.createDataFrame([(i, str(i % 7)) for i in range(60)], "id long, v string")
    rule = relationships.Rule("SAME_ID", ("v", "w")).confirmed()
    both = df.withColumn("w", F.col("v"))
    out, issues = generate_output(both, "id", [Policy("v", "PATTERN_REPLACE", "ALPHANUMERIC_CODE"), Policy("w", "PATTERN_REPLACE", "ALPHANUMERIC_CODE")], rules=[rule])
    assert out.where("v <> w").isEmpty() and issues.where("code like 'SAME_ID%'").isEmpty()


def test_balanced_choice():
    s = [coverage.Stratum("a", "x", "", 10, 2, 0, 4), coverage.Stratum("b", "y", "r", 10, 1, 0, 3)]
    rows = [(i, [k for k, on in (("a", i % 3 == 0), ("b", i % 4 == 0)) if on]) for i in range(12)]
    got = coverage.balanced_choice(rows, s, 6, mandatory=[5], preferred=[7, 11])
    inside = dict(rows)
    assert len(got) == 6 and {5, 7, 11} <= set(got) and sum("a" in inside[i] for i in got) == 2 and sum("b" in inside[i] for i in got) == 1


def test_registry_and_groups():
    r = relationships.Registry().confirm(relationships.mapping_group("a", "b")).confirm(relationships.Rule("NUMERIC_EQUAL", ("p", "q")))
    assert r.scope("a") == r.scope("b") != r.scope("c") and r.shift_group("z") == ("z",)
    for rule in (relationships.Rule("NUMERIC_RATIO", ("m", "q")), relationships.mapping_group("b", "c"), relationships.Rule("NUMERIC_EQUAL", ("p", "q"))):
        with pytest.raises(ValueError):
            r.confirm(rule)
    assert relationships.by_priority(["x", "total_price", "is_active"]) == ["total_price", "is_active", "x"]


def test_patterns(spark):
    from quillmask.functions import patterns

    assert patterns.common_affix(["INV-1", "INV-22", "INV-3", "X"]) == "INV-" and patterns.safe_affix("INV") and not patterns.safe_affix("AB123")
    assert patterns.summary(["AB-12", "AB-34"]).variable == (3, 4)
    assert patterns.list_evidence(["a1, b2", "c3; d4", "e5|f6"])[0] == "HIGH" and not patterns.reads_lists("AUTO", ["one", "two"]) and patterns.reads_lists("FORCE", [])
    made = one(spark, ["x", "y"], lambda c: patterns.masked(r"AA-99\A", 1, "s", c))
    assert all(len(m) == 6 and m[2] == "-" and m[5] == "A" and m[:2].isupper() and m[3:5].isdigit() for m in made)
    lists = one(spark, ["AB1, CD2; AB1"], lambda c: actions.pattern_replaced(Policy("c", "PATTERN_REPLACE", params={"lists": True}), c, F.lit(1), 1))[0]
    assert lists[:3] == lists[-3:] != "AB1" and lists[3:5] == ", "


def test_configuration(spark):
    from quillmask.plans import config

    old = {"version": 1, "generated": [{"name": "n", "type": "sequence", "settings": {"step": 0, "width": 99}, "null_rate": 25}, {"name": "N", "type": "uuid"}]}
    fields = config.fields_of(old)
    assert [f.name for f in fields] == ["n", "N_2"] and fields[0].settings == {"step": 1, "width": 20} and fields[0].null_rate == 0.25
    assert config.restored_fields(config.stored_fields(fields, " my\tset "))[0] == "my set"
    columns = config.combined(config.source_columns(["a", "b"]), config.source_columns(["c"]))
    assert [c.id for c in columns] == ["source-1", "source-2", "source-1-2"] and config.schema(columns).names == ["a", "b", "c"]
    with pytest.raises(ValueError):
        config.schema(config.combined(columns, config.source_columns(["a"])))
    with pytest.raises(ValueError):
        config.upgraded({"version": 9})
    assert config.input_options({"delimiter": "tab", "header": "no"}) == {"delimiter": "\t", "header": False, "faithful": False}
    assert config.with_defaults(Policy("x", "CLEAR", params={"odd": 1}))[1] == ["x: CLEAR takes no odd"] and "CLEAR" in config.explained(Policy("x", "CLEAR"))


def test_first_parent_needs_no_child(spark):
    parent = generate.Table("p", (generate.Field("k", "sequence"),), 300, "k")
    child = lambda most: generate.Table("c", (generate.Field("k", "foreign-key", {"table": "p", "mode": "DRIVER", "minimum": 0, "maximum": most}),), 1)
    assert generate.generated(spark, [parent, child(0)])["c"].count() == 1
    firsts = [generate.generated(spark, [parent, child(1)], seed)["c"].where("k = 'ID-00001'").count() for seed in range(1, 7)]
    assert set(firsts) == {0, 1}


def test_text_input_and_undecoded(spark, tmp_path):
    df, said = delimited.read_text(spark, 'id,name\n1,"A,b"\n\n2,C,x\n')
    assert [r["_row"] for r in df.collect()] == [1, 2, 3] and said["issues"] == [("FIELD_COUNT_MISMATCH", 0, 2), ("FIELD_COUNT_MISMATCH", 1, 2)]
    f = tmp_path / "b.csv"
    f.write_bytes(b"id,name\n" + b"1,ok\n" * 20000 + b"2,\xff\xfe\n")
    assert delimited.undecoded(delimited.read_delimited(spark, str(f))[0]).first()[0] == 2


def test_offsets_in_bulk():
    from quillmask.plans import config

    plan = [Policy("d", "SHIFT", "DATE", params={"offset": 9, "layout": "DMY"}), Policy("t", "SHIFT", "TIME", params={"offset": 9}), Policy("n", "SHIFT", "NUMERIC_ID", params={"offset": 9}), Policy("k")]
    made = config.with_offsets(plan, days=-3, number=7)
    assert [p.params.get("offset") for p in made] == [-3, 9, 7, None] and made[0].params["layout"] == "DMY" and made[3] == plan[3]
    for bad in ([plan, 0], [[Policy("a", "SHIFT", "AMBIGUOUS_DATE", params={"offset": 1})], 2]):
        with pytest.raises(ValueError):
            config.with_offsets(*bad)


def test_templates_and_export():
    from quillmask.plans.masking import may_export_all

    made = generate.from_template("people", 5, ["People", "people_2"])
    assert (made.name, made.rows) == ("people_3", 5) and generate.from_template("people", 1).name == "people" and generate.from_template("blank", 1).fields == ()
    with pytest.raises(ValueError):
        generate.from_template("nothing", 1)
    good, bad = {"zones": {"privacy": "PASS"}}, {"zones": {"privacy": "FAIL", "fidelity": "PASS"}}
    assert may_export_all({"a": good}) == (True, "") and may_export_all({"a": good, "b": bad}) == (False, "b failed: privacy") and not may_export_all({})[0]


def test_integrity_and_coverage_in_words(spark):
    from quillmask.plans.masking import integrity_findings, integrity_model

    parent = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y"), (None, "z")], "k string, v string")
    child = spark.createDataFrame([("1", "x"), ("1", "no"), ("3", "")], "k string, v string")
    checks = {"links": [("c", "k", "p")], "counts": [("c", "k", "p", 0, 1)], "linked": [("c", "k", "p", [("v", "v")])]}
    found = integrity_findings(integrity_model({"p": parent, "c": child}, {"p": "k"}, **checks))
    assert found == ["1 duplicate primary-key row", "1 orphan foreign key", "1 parent with too few or many children", "1 linked cell that differs from its parent"]
    assert integrity_findings(integrity_model({"p": parent.limit(0), "c": child.limit(0)}, {"p": "k"}, **checks)) == []
    found = [coverage.Scenario(i, "KIND", w, "v", F.col("v") == v) for i, w, v in (("a", 5, "x"), ("b", 3, "q"))]
    view = coverage.coverage_view(parent, found)
    said, why = coverage.coverage_notice(coverage.output_plan(found, 2), view)
    assert said == {"required": 2, "covered": 1, "missing": 1, "ratio": 0.625} and why == "no row shows b; more rows won't help"
    assert "too few" in coverage.coverage_notice(coverage.output_plan(found, 1), view)[1]
