import pytest
from pyspark.sql import functions as F

from quillspark import __main__ as cli
from quillspark.operators import builds, corpus, slots
from quillspark.operators import evaluation as ev


def test_running_sums_over_ranges(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v")).repartition(5)
    got = {r.id: r.upto for r in corpus.running(rows, [F.col("id").desc()], {"upto": "v"}).collect()}
    want, total = {}, 0
    for i in range(999, -1, -1):
        total += i % 7
        want[i] = total
    assert got == want
    assert corpus.running(rows.limit(0), [F.col("id")], {"upto": "v"}).collect() == []


def test_nearest_rank_with_nulls_ties_and_a_large_group(spark):
    values = [("a", float(i % 97)) for i in range(2001)] + [("b", 5.0), ("b", None), (None, 1.0), (None, 2.0), (None, 3.0)]
    rows = spark.createDataFrame(values, "g string, v double").repartition(4)
    got = {r.g: (r.q10, r.q50, r.q90) for r in ev.nearest_rank(rows, "v", "g").collect()}
    a = sorted(float(i % 97) for i in range(2001))
    assert got == {"a": (a[200], a[1000], a[1800]), "b": (None, None, 5.0), None: (1.0, 2.0, 3.0)}
    assert ev.nearest_rank(rows.limit(0), "v", "g").collect() == []


def test_best_f1_is_that_of_brute_force(spark):
    data = [(((i * 7919) % 101) / 101, (i * 31) % 5 < 2) for i in range(400)]
    best = ev.best_f1_threshold(spark.createDataFrame(data, "score double, label boolean")).first()
    positives = sum(y for _, y in data)
    f1 = {t: 2 * sum(y for s, y in data if s >= t) / (sum(s >= t for s, _ in data) + positives) for t, _ in data}
    assert best.threshold == max(f1, key=lambda t: (round(f1[t], 12), t)) and best.f1 == pytest.approx(max(f1.values()))


def test_retention_card(spark):
    rows = spark.createDataFrame([("acme shop", "acme shop"), ("acme shop", "acne shop"), ("ab", "<unk>"), ("", "")], "expected string, output string")
    card = ev.retention_card(rows, ("acme", "shop")).first()
    assert (card.total, card.exact_match, card.unk_rate, card.brand_retention) == (4, 50.0, 25.0, 50.0)
    assert card.cer == pytest.approx(100 * (1 / 9 + 5 / 2) / 4)
    assert ev.retention_card(rows.limit(0), ("acme",)).first().brand_retention == 100.0


def test_clean_targets_and_ranked_corpora(spark):
    texts = ["Đường  Nguyễn Trãi quận một", "đường nguyễn trãi quận một", "bệnh viện thành phố", "chợ bến thành mới", "", None, "0912345678 gọi ngay"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "at long, text string")
    held = spark.createDataFrame([("chợ bến thành mới",)], "target string")
    targets = builds.clean_targets(rows, "text", "at", held)
    assert {r.target for r in targets.collect()} == {"đường nguyễn trãi quận một", "bệnh viện thành phố"}
    pairs = builds.ranked_corpora(targets).collect()
    assert sum(r.lane == "clean" for r in pairs) == 2 and all(r.input == r.target for r in pairs if r.lane == "clean")
    assert all(r.input != r.target and slots.SLOTS[r.family] for r in pairs if r.lane == "noisy")
    assert len({(r.target, r.split) for r in pairs}) == 2


def test_production_lanes_hold_their_weights(spark):
    pairs = spark.createDataFrame([(f"t{i}", f, f"x{i}") for i in range(20) for f in ("identity", "keyboard_drop", "word_boundary")], "target string, family string, input string")
    got = builds.production_lanes(pairs, {"identity": 7, "keyboard": 10, "word": 3}, 100).groupBy("pool").count().collect()
    assert {r.pool: r["count"] for r in got} == {"identity": 35, "keyboard": 50, "word": 15}


def test_sanitized(spark):
    rows = spark.createDataFrame(
        [
            (1, "nhà 12015 Lê Lợi", "nhà 120/15 lê lợi", "address_symbol"),
            (2, "nhà 120/15 lê lợi", "nhà 120/15 lê lợi", "address_symbol"),
            (3, "32322/5a x", "323/22/5a x", "address_symbol"),
            (4, "Đ lê lợi", "phố lê lợi", "address_abbreviation"),
            (5, "x", "UBND và bv và bva", "address_abbreviation"),
            (6, "d lê", "phố lê bv", "clean"),
            (7, None, None, "address_symbol"),
            (8, None, None, None),
        ],
        "id long, input string, expected string, error_type string",
    )
    got = {r.id: (r.input, r.expected) for r in builds.sanitized(rows).collect()}
    assert got == {
        1: ("nhà 120 15 Lê Lợi", "nhà 120/15 lê lợi"),
        2: ("nhà 120/15 lê lợi", "nhà 120/15 lê lợi"),
        3: ("323 22/5a x", "323/22/5a x"),
        4: ("Đ lê lợi", "đường lê lợi"),
        5: ("x", "ủy ban nhân dân và bệnh viện và bva"),
        6: ("d lê", "phố lê bv"),
        7: (None, None),
        8: (None, None),
    }


def test_command_line_lists_queries_and_prints_sql(capsys):
    assert cli.main(["list"]) == 0
    assert "vocabulary *" in capsys.readouterr().out.splitlines()
    assert cli.main(["sql", "vocabulary"]) == 0
    assert "SELECT" in capsys.readouterr().out
