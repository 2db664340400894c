"""Draws: strided, even, round-robin, by shares, paired, split. All are drawn by a seeded MD5 of the key, which any engine
has, so that a draw is the same on every run and whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sizes import placed


def seeded(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def strided(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows at equal steps in the order of the key; all if there are no more."""
    total = rows.count()
    if n >= total:
        return rows
    step = max(1, total // n)
    return placed(rows, [key]).filter((F.col("place") % step == 0) & (F.col("place") < step * n)).drop("place")


def round_robin(rows: DataFrame, by: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows, one of each group in turn, in a seeded order within each."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(seeded(seed, key), key))
    return rows.withColumn("turn", turn).orderBy("turn", by).limit(n).drop("turn")


def shares(size: int, available: dict[str, int], kinds: list[str]) -> dict[str, int]:
    """``size`` dealt evenly over kinds in order; what a kind lacks the others give, while they have any."""
    out, left = dict.fromkeys(kinds, 0), size
    while left and (open_ := [k for k in kinds if out[k] < available.get(k, 0)]):
        for i, k in enumerate(open_):
            take = min(left // len(open_) + (i < left % len(open_)), available.get(k, 0) - out[k])
            out[k] += take
        left = size - sum(out.values())
    return out


def drawn_by_kind(rows: DataFrame, kind: str, key: str, size: int, kinds: list[str], taken: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """``size`` rows not taken yet, spread over kinds by ``shares``."""
    free = rows if taken is None else rows.join(taken.select(key), key, "left_anti")
    available = {r[kind]: r["count"] for r in free.filter(F.col(kind).isin(kinds)).groupBy(kind).count().collect()}  # a row a kind
    quota = shares(size, available, kinds)
    place = F.row_number().over(Window.partitionBy(kind).orderBy(seeded(seed, key), key))
    wanted = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])
    return free.filter(F.col(kind).isin(kinds)).withColumn("n", place).filter(F.col("n") <= F.try_element_at(wanted, F.col(kind))).drop("n")


def split_by(rows: DataFrame, flag: str, by: str, key: str, n: int, share: float, seed: int = 7) -> DataFrame:
    """``n`` rows, ``share`` of them with the flag, each part round-robin over groups; a part that is short is made up by the
    other."""
    have = {r[flag]: r["count"] for r in rows.groupBy(flag).count().collect()}
    rest = min(n - round(n * share), have.get(False, 0))
    first = min(n - rest, have.get(True, 0))
    rest = min(n - first, have.get(False, 0))
    return round_robin(rows.filter(F.col(flag)), by, key, first, seed).unionByName(round_robin(rows.filter(~F.col(flag)), by, key, rest, seed + 1))


def paired(rows: DataFrame, key: str, company: str, n: int, seed: int = 7) -> DataFrame:
    """``first, second``: ``n`` pairs of keys of different companies, none used twice.

    Rows are placed by falling size of their company; a row's partner stands half of all rows further. As no company but
    one can hold more than half, partners differ in company wherever that is possible; what meets its own is left out."""
    sizes = rows.groupBy(company).agg(F.count("*").alias("_size"))
    order = placed(rows.join(sizes, company).select(key, company, "_size", seeded(seed, key).alias("_draw")), [F.desc("_size"), company, "_draw", key])
    total = rows.count()
    half = total // 2
    a = order.filter(F.col("place") < half).select(F.col(key).alias("first"), F.col(company).alias("_a"), "place", "_draw")
    b = order.filter(F.col("place") >= total - half).select(F.col(key).alias("second"), F.col(company).alias("_b"), (F.col("place") - (total - half)).alias("place"))
    return a.join(b, "place").filter("_a <> _b").orderBy("_draw", "first").limit(n).select("first", "second")


def train_valid(rows: DataFrame, key: str, fraction: float, seed: int = 7) -> DataFrame:
    """Rows with ``part``: the last ``fraction``, one row at least, in a seeded order is valid, the rest train."""
    total = rows.count()
    cut = total - max(1, round(total * fraction))
    order = placed(rows.withColumn("_draw", seeded(seed, key)), ["_draw", key])
    return order.withColumn("part", F.when(F.col("place") >= cut, "valid").otherwise("train")).drop("_draw", "place")


def kind_of_passage(text: Column, core: str, scaled: str) -> Column:
    """core: names a core metric beside a figure; scaled: a figure with a scale; plain: any number but a year; else null."""
    numbers = F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), 0)
    states = F.exists(numbers, lambda x: ~F.replace(x, F.lit(","), F.lit("")).rlike(r"^(?:19|20)\d\d$"))
    return F.when(text.rlike(core) & (states | text.rlike(scaled)), "core").when(text.rlike(scaled), "scaled").when(states, "plain")


def eligible(text: Column, least: int = 400, share: float = 0.85) -> Column:
    """Long enough, and prose: letters and white space."""
    letters = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\s]", ""))
    return (F.length(text) >= least) & (letters >= share * F.length(text))


def unquoted(rows: DataFrame, text: str, banned: DataFrame, banned_text: str, n: int = 4) -> DataFrame:
    """Rows that share no run of ``n`` words with a banned text; of texts equal in lower case the one with the least hash
    of its row stays."""
    runs = lambda df, c: df.withColumn("_w", F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)).filter(F.size("_w") >= n).withColumn("_g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.xxhash64(F.slice("_w", i, n))))))
    keyed = rows.withColumn("_low", F.lower(text))
    hits = runs(keyed, text).select("_low", "_g").join(runs(banned, banned_text).select("_g").distinct(), "_g", "left_semi").select("_low").distinct()
    return keyed.join(hits, "_low", "left_anti").dropDuplicates(["_low"]).drop("_low")
