"""Curation of query logs and pairs: safe queries, unique matches, blocked fuzzy matches, margins, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.hashing import hash60
from quillspark.functions.normalize import plain_text
from quillspark.functions.predicates import composable

#: Fixed values of acronyms: words before a place name, words that name nothing by themselves, and short forms with a meaning of their own.
ANCHORS = ("duong", "pho", "hem", "ngo", "truong", "benh", "vien", "dai", "hoc", "thpt", "thcs", "ubnd", "xa", "phuong", "quan", "huyen")
GENERIC = ("duong", "pho", "phuong", "quan", "huyen", "xa", "thi", "tran", "thanh", "tinh", "thon", "to", "khu", "ap", "so", "hem", "ngo")
RESERVED = (
    "q", "p", "tp", "bv", "ubnd", "thpt", "thcs", "dh", "kcn", "cc", "ql", "tl", "h", "x", "d", "dg", "dt", "tx", "tt", "ct", "cty", "tnhh", "hdnd", "cd", "mn",
    "kdt", "tttm", "bql", "hn", "hcm", "sg", "dn", "hp", "bd", "vt", "nt", "gv", "bt", "tb", "ad", "ltk", "nct", "hbt", "dbp", "pvh", "ntmk", "nvl",
)


def safe(query: Column, longest: int = 100) -> Column:
    """Short enough, and neither a phone number nor an address of electronic mail in it."""
    return (F.length(query) <= longest) & ~query.rlike(r"(^|[^0-9])(\+?84|0)([ .\-]?[0-9]){8,10}([^0-9]|$)") & ~query.rlike(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")


def token_compatible(observed: Column, intended: Column, error_type: Column) -> Column:
    """May be labelled word by word: no address symbol, both sides filled, equally many words."""
    n = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return ~F.contains(F.coalesce(error_type, F.lit("")), F.lit("address_symbol")) & (n(observed) > 0) & (n(observed) == n(intended))


def incomplete(words: Column, endings: list[str]) -> Column:
    """The last word is one that needs another."""
    return F.coalesce(F.element_at(words, -1).isin(endings), F.lit(False))


def zero_click(log: DataFrame, raw: str, key: Column, order: str) -> DataFrame:
    """key, frequency, and its first raw form."""
    return log.groupBy(key.alias("key")).agg(F.count("*").alias("frequency"), F.min_by(raw, order).alias("form"))


def unique_match(queries: DataFrame, names: DataFrame, folded: str) -> DataFrame:
    """Queries whose folded form is that of exactly one name (``folded`` in both, ``name`` in names)."""
    one = names.groupBy(F.col(folded).alias("__f")).agg(F.count_distinct("name").alias("__n"), F.min("name").alias("target")).filter("__n = 1")
    return queries.join(one, queries[folded] == F.col("__f")).drop("__f", "__n")


def blocked_match(queries: DataFrame, names: DataFrame, least: float = 0.85, margin: float = 0.03, head: int = 3, band: int = 5) -> DataFrame:
    """query, name, score and the gap to the second: the best name by 1 - edits / longer length.

    Queries meet the names that share their first ``head`` characters and whose length is
    in the same band or the one beside: an equi-join on both.  Kept if the best is good
    enough and far enough ahead of the second.
    """
    start = lambda c: F.substring(c, 1, head)
    bands = F.explode(F.array(*[F.floor(F.length("name") / band) + k for k in (-1, 0, 1)]))
    spread = names.select("name", start("name").alias("n_start"), bands.alias("n_band"))
    asked = queries.select("query", start("query").alias("start"), F.floor(F.length("query") / band).alias("band"))
    met = asked.join(spread, (F.col("start") == F.col("n_start")) & (F.col("band") == F.col("n_band")))
    longer = F.greatest(F.length("query"), F.length("name"))
    scored = met.withColumn("score", 1 - F.levenshtein("query", "name") / longer)
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), "name")
    top = scored.withColumns({"n": F.row_number().over(place), "next": F.lead("score").over(place)}).filter("n = 1")
    gap = F.col("score") - F.coalesce("next", F.lit(0.0))
    return top.withColumn("gap", gap).filter((F.col("score") >= least) & (F.col("gap") >= margin)).select("query", "name", "score", "gap")


def clear_winner(offers: DataFrame, token: str, frequency: str, least: int = 50, times: float = 5.0) -> DataFrame:
    """The most frequent candidate of each token, if frequent enough and ``times`` as frequent as its rival."""
    place = Window.partitionBy(token).orderBy(F.col(frequency).desc(), "term")
    top = offers.withColumns({"n": F.row_number().over(place), "rival": F.lead(frequency).over(place)}).filter("n = 1")
    return top.filter((F.col(frequency) >= least) & (F.col(frequency) >= times * F.coalesce("rival", F.lit(0)))).select(token, "term", frequency, F.coalesce("rival", F.lit(0)).alias("rival"))


def held_out_runs(rows: DataFrame, id_col: str, words: str, phrases: list[list[str]]) -> DataFrame:
    """Rows that contain one of a short, fixed list of phrases word by word; ``words`` is an array column."""
    hit = F.lit(False)
    for p in phrases:
        n = len(p)
        hit = hit | ((F.size(words) >= n) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), run_is(words, p)))
    return rows.filter(hit).select(id_col)


def run_is(words: str, phrase: list[str]):
    return lambda i: F.slice(words, i, len(phrase)) == F.array(*map(F.lit, phrase))


def paired_bootstrap(gains: DataFrame, key: str, gain: str, rounds: int = 200, seed: int = 1) -> DataFrame:
    """Mean gain and the 2.5 and 97.5 percentiles of its bootstrap.

    Every row draws its own number of copies in each round, Poisson of mean one, from a hash
    of its key and the round: no resampling moves rows, and reruns agree.
    """
    each = gains.select(key, gain, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("round")), F.lit(1_000_003)) + 0.5) / 1_000_003
    copies, upto, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 8):
        upto += term
        copies = copies + F.when(u >= upto, 1).otherwise(0)
        term /= k
    means = each.withColumn("copies", copies).groupBy("round").agg((F.sum(F.col("copies") * F.col(gain)) / F.sum("copies")).alias("mean"))
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high")).join(gains.agg(F.avg(gain).alias("mean"), F.count("*").alias("n")))


def boosted_trees(rows: DataFrame, features: list[str], label: str, trees: int = 10):
    """A gradient-boosted classifier over feature columns; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep"), GBTClassifier(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=3, seed=1)]
    return Pipeline(stages=stages).fit(rows)


def split_files(rows: DataFrame, split: str, path: str) -> None:
    """A folder of Parquet per split."""
    rows.write.partitionBy(split).parquet(path)


def flat(rows: DataFrame, arrays: list[str], separator: str = "|") -> DataFrame:
    """Arrays joined to text, for a review sheet."""
    return rows.withColumns({a: F.array_join(a, separator) for a in arrays})


def clean_queries(queries: DataFrame, key: str, words: str, lexicon: DataFrame) -> DataFrame:
    """Keys of queries of which every word is in the lexicon (column ``term``) or has no letter.

    Only distinct words meet the lexicon, so that a frequent word is looked up once; a query
    without words is clean.
    """
    each = queries.select(key, F.explode(F.array_distinct(words)).alias("__w")).filter(F.col("__w").rlike(r"\p{L}"))
    unknown = each.select("__w").distinct().join(lexicon.select(F.col("term").alias("__w")), "__w", "left_anti")
    return queries.select(key).join(each.join(unknown, "__w").select(key).distinct(), key, "left_anti")


def dominant(rows: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """key, label, n: the most frequent label of each key; of equally frequent ones the one that stands first, then the smaller."""
    counts = rows.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col("__first"), F.col(label)))
    return counts.groupBy(key).agg(best.alias("__b")).select(key, f"__b.{label}", "__b.n")


def composition_variants(targets: DataFrame, target: str, seed: str) -> DataFrame:
    """The columns of ``targets`` with kind and input: four variants that pair lost marks with lost spaces.

    Targets are 2 to 6 words of letters with at least one mark; the others give no row.  The
    lost space is chosen by a hash of the target.
    """
    t = F.col(target)
    rows = targets.filter(composable(t) & (plain_text(t) != t)).withColumn("__ws", F.split(t, " "))
    rows = rows.withColumn("__at", (hash60(seed, t) % (F.size("__ws") - 1)).cast("int") + 1)
    joined = F.concat_ws(" ", F.slice("__ws", F.lit(1), F.col("__at") - 1), F.concat(F.get("__ws", F.col("__at") - 1), F.get("__ws", F.col("__at"))), F.slice("__ws", F.col("__at") + 2, F.size("__ws")))
    rows = rows.withColumn("__joined", joined)
    made = {
        "missing_diacritics_only": plain_text(t),
        "boundary_one_only": F.col("__joined"),
        "missing_diacritics_boundary_one": plain_text(F.col("__joined")),
        "missing_diacritics_boundary_all": F.replace(plain_text(t), F.lit(" "), F.lit("")),
    }
    four = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("input")) for k, v in made.items()]))
    return rows.select(*targets.columns, four.alias("__v")).select(*targets.columns, "__v.kind", "__v.input")


def acronym_candidates(ws: Column, anchors: tuple[str, ...] = ANCHORS, generic: tuple[str, ...] = GENERIC, reserved: tuple[str, ...] = RESERVED) -> Column:
    """array<struct<input, short>>: a text (its words) with a run of four or three words replaced by their initials.

    The run is of letters, at least two of its words are not generic, one of the five words
    before it is an anchor, and its initials are no reserved short form.  Words are compared
    in lower case without marks.
    """
    fold = lambda w: plain_text(F.lower(w))
    words = lambda values: F.array(*map(F.lit, values))

    def runs(n: int) -> Column:
        def made(i: Column) -> Column:
            run = F.slice(ws, i, n)
            short = F.array_join(F.transform(run, lambda w: F.substring(fold(w), 1, 1)), "")
            before = F.transform(F.slice(ws, F.greatest(i - 5, F.lit(1)), i - F.greatest(i - 5, F.lit(1))), fold)
            telling = F.size(F.filter(run, lambda w: ~F.array_contains(words(generic), fold(w)))) >= 2
            ok = F.forall(run, lambda w: w.rlike(r"^\p{L}+$")) & telling & F.arrays_overlap(before, words(anchors)) & ~F.array_contains(words(reserved), short)
            text = F.array_join(F.concat(F.slice(ws, F.lit(1), i - 1), F.array(short), F.slice(ws, i + n, F.size(ws))), " ")
            return F.when(ok, F.struct(text.alias("input"), short.alias("short")))

        starts = F.when(F.size(ws) > n, F.sequence(F.lit(2), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, made), lambda r: r.isNotNull())

    return F.concat(runs(4), runs(3))
