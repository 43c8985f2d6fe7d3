"""Column mapping (J10-J14), the bundles (A15, B55, C6, F10, G6) and table reading (S1): every one is called here."""
import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerlens.functions.similarity import ratio
from ledgerlens.operators import cells, consolidate, formats, mapping, profile, twosample
from ledgerlens.operators.business import bundles, roles
from ledgerlens.sources import tables
from ledgerlens.sources.fixtures import fixture


def two_tables(spark):
    a = spark.createDataFrame([(1, "ann@x.org", "Ann", 10.0), (2, "bob@x.org", "Bob", 20.0), (3, None, "Cid", None)],
                              "customer_id long, email string, full_name string, price double")
    b = spark.createDataFrame([(2, "bob@x.org", "bob ", "10.0"), (4, "dan@x.org", "Dan", "7")],
                              "client_id long, e_mail string, name string, amount string")
    return a, b


def test_semantic_score():
    """Both names hold a variant of one family, whatever the punctuation."""
    assert mapping.semantic_score("Customer-Email", "e_mail address") == 90.0
    assert mapping.semantic_score("unit price", "TotalCost") == 90.0
    assert mapping.semantic_score("colour", "weight") == 0.0


def test_column_similarity(spark):
    """Every pair once; name, type and value parts by definition, and their weighted sum."""
    a, b = two_tables(spark)
    rows = {(r["col_a"], r["col_b"]): r for r in mapping.column_similarity(a, b).collect()}
    assert len(rows) == 16
    values = {(t, c): {str(r[c]).strip().lower() for r in df.collect() if r[c] is not None} for t, df in (("a", a), ("b", b)) for c in df.columns}
    for (x, y), r in rows.items():
        assert r["name_similarity"] == pytest.approx(ratio(x, y)) and r["semantic_similarity"] == mapping.semantic_score(x, y)
        assert r["type_similarity"] == (100.0 if dict(a.dtypes)[x] == dict(b.dtypes)[y] else 0.0)
        va, vb = values["a", x], values["b", y]
        assert r["value_similarity"] == pytest.approx(100 * len(va & vb) / len(va | vb))
        assert r["overall_score"] == pytest.approx(0.3 * r["name_similarity"] + 0.2 * r["semantic_similarity"] + 0.2 * r["pattern_similarity"]
                                                   + 0.1 * r["type_similarity"] + 0.2 * r["value_similarity"])
    assert rows["email", "e_mail"]["pattern_similarity"] > 0 and rows["full_name", "amount"]["semantic_similarity"] == 0


def test_suggested_mappings_and_reasons(spark):
    """The best three B columns of each A column above 20, ranked over all, each with its reasons."""
    a, b = two_tables(spark)
    sim = [r for r in mapping.column_similarity(a, b).collect() if r["overall_score"] > 20]
    want = []
    for c in a.columns:
        want += sorted((r for r in sim if r["col_a"] == c), key=lambda r: (-r["overall_score"], r["pos_b"]))[:3]
    want = sorted(want, key=lambda r: (-r["overall_score"], r["pos_a"], r["pos_b"]))[:10]
    got = mapping.suggest_mappings(a, b).orderBy("rank").collect()
    assert [(r["col_a"], r["col_b"]) for r in got] == [(r["col_a"], r["col_b"]) for r in want]
    for r, w in zip(got, want):
        parts = []
        if w["name_similarity"] > 40:
            parts.append(f"Column names are {'very' if w['name_similarity'] > 70 else 'somewhat'} similar ({round(w['name_similarity'])}% match)")
        if w["semantic_similarity"] > 80:
            parts.append("Columns appear to contain the same type of data")
        if w["pattern_similarity"] > 30:
            parts.append(f"Data patterns are similar ({round(w['pattern_similarity'])}% match)")
        if w["value_similarity"] > 20:
            parts.append(f"Contains overlapping values ({round(w['value_similarity'])}% overlap)")
        if w["type_similarity"] > 90:
            parts.append("Compatible data types")
        assert r["reasons"] == ("; ".join(parts) or "Basic compatibility detected")
    assert (got[0]["col_a"], got[0]["col_b"]) == ("email", "e_mail")


def test_read_table_and_names(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    df.write.csv(f"{tmpdir_path}/t", header=True)
    assert tables.read_table(spark, f"{tmpdir_path}/t", "csv", header=True, inferSchema=True).collect() == df.collect()
    assert tables.table_names({"z": df, "a": df}) == ["z", "a"]


def ran(bundle):
    """Every frame of a bundle runs; name: rows."""
    return {name: df.collect() for name, df in bundle.items()}


def test_table_analysis(spark):
    out = ran(profile.analyze_table(fixture(spark, SF, "fx_finance").limit(40)))
    assert {"shape", "missing", "descriptive", "outliers", "histogram", "normality", "correlation"} <= set(out)
    assert out["shape"][0]["total_rows"] == 10 and len(out["descriptive"]) == 10


def test_business_bundles(spark):
    s = fixture(spark, SF, "fx_sales")
    out = {**ran(bundles.profitability_bundle(s, "amount", "cost", "discount", "category", "order_date", "quantity")),
           **ran(bundles.kpi_bundle(s, "amount", "order_date", "order_id", "customer_id")),
           **ran(bundles.alert_bundle(s, "amount", "order_date", "order_id", "customer_id")),
           **ran(bundles.product_bundle(s, "product", "amount", "order_date")),
           **ran(bundles.customer_bundle(s, "customer_id", "amount", "category", "order_date", "rating"))}
    assert len(out) == 26 and all(out[n] for n in out if n != "alerts"), {n: len(x) for n, x in out.items()}
    assert out["retention"][0]["customers"] == s.select("customer_id").distinct().count()


def test_formula_and_format_bundles(spark):
    out = ran(cells.analyze(fixture(spark, SF, "fx_cells")))
    assert {"formulas", "validation_summary", "levels", "dependents", "statistics"} <= set(out) and all(out.values())
    assert len(out["levels"]) == len(out["formulas"]) == out["statistics"][0]["total_formulas"]
    a, b = (fixture(spark, SF, f"fx_attrs_{t}") for t in "ab")
    out = ran(formats.compare_formats(a, b, fixture(spark, SF, "fx_objects_a"), fixture(spark, SF, "fx_objects_b")))
    assert set(out) == {"diff", "presence", "summary", "examples", "significance", "formatted_cells", "structure", "rules"} and all(out.values())


def test_consolidation_strategies(spark):
    t = {"customers": fixture(spark, SF, "fx_cons_customer"), "suppliers": fixture(spark, SF, "fx_cons_supplier")}
    n = {k: df.count() for k, df in t.items()}
    assert consolidate.consolidate(t, "union", missing="fill").count() == sum(n.values())
    merged = consolidate.consolidate(t, "merge", key="key")
    assert merged.count() == t["customers"].select("key").union(t["suppliers"].select("key")).distinct().count()
    assert consolidate.consolidate(t, "schema").count() == 7
    with pytest.raises(ValueError):
        consolidate.consolidate(t, "other")


def test_significance_counts(spark):
    """H6 and H7 on columns whose answers are plain: one differs, one doesn't."""
    a = spark.range(400).select((F.col("id") % 20).cast("double").alias("same"), (F.col("id") % 20).cast("double").alias("moved"))
    b = spark.range(300).select((F.col("id") % 20).cast("double").alias("same"), (F.col("id") % 20 + 7).cast("double").alias("moved"))
    tests = twosample.compare_tests(a, b)
    rows = {r["column"]: r for r in tests.collect()}
    assert rows["moved"]["t_p_value"] < 1e-9 < 0.9 < rows["same"]["t_p_value"]
    assert rows["moved"]["ks_statistic"] == pytest.approx(7 / 20) and rows["same"]["ks_statistic"] == pytest.approx(0)
    assert twosample.significance_counts(tests).first().asDict() == {
        "columns_tested": 2, "significant_mean_differences": 1, "significant_distribution_differences": 1}


def test_keyword_lookup(spark):
    df = spark.createDataFrame([("x", 1.0, 2)], "sales_name string, net_sales double, sales_count int")
    assert roles.first_numeric_by_keywords(df, ["sales"]) == "net_sales"
    assert roles.first_numeric_by_keywords(df, ["absent"]) is None


def test_merge_on_key_equals_a_chain_of_full_outer_joins(spark):
    """Repeated, absent and null keys, three tables, clashing columns; no full outer join in the plan."""
    rows = {"a": [(1, "a1"), (1, "a2"), (2, "a3"), (None, "a4"), (None, "a5"), (5, None)], "b": [(1, "b1"), (3, "b2"), (None, "b3")],
            "c": [(1, "c1"), (1, "c2"), (3, "c3"), (7, "c4")]}
    tables = {n: spark.createDataFrame(r, "k int, v string").withColumn(f"only_{n}", F.lit(n)) for n, r in rows.items()}
    out = consolidate.merge_on_key(tables, "k")
    want = [(k, (v, "a"), None, None) for k, v in rows["a"]]
    for at, n in ((2, "b"), (3, "c")):
        left, right, new = want, rows[n], []
        for w in left:
            hits = [v for k, v in right if k == w[0]]
            new += [(*w[:at], (v, n), *w[at + 1:]) for v in hits] or [w]
        new += [(k, *[(v, n) if i == at else None for i in (1, 2, 3)]) for k, v in right if k not in {w[0] for w in left}]
        want = new
    flat = lambda x: x or (None, None)
    want = [(w[0], *flat(w[1]), *flat(w[2]), *flat(w[3]), ";".join(n for n, x in zip("abc", w[1:]) if x)) for w in want]
    assert out.columns == ["k", "v", "only_a", "v_from_b", "only_b", "v_from_c", "only_c", "_sources"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    assert "FullOuter" not in out._jdf.queryExecution().executedPlan().toString()
