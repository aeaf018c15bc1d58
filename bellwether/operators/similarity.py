"""Vector similarity: novelty against the past week, and nearest neighbours.

Both need a product of vector blocks, which is where numpy earns its place. Spark decides
the blocks and moves them; a task sees two blocks of bounded size and returns one row per
item, never one per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bellwether.session import frozen

_STATS = "news_id long, best double, n long, hits long"


def _unit_rows(col: pd.Series) -> np.ndarray:
    m = np.asarray(col.tolist(), dtype=np.float64)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)


def _compare(threshold: float, reach: np.timedelta64):
    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"news_id": [], "best": [], "n": [], "hits": []})
        lt, rt = left.published_at.values, right.published_at.values
        li, ri = left.news_id.values, right.news_id.values
        sims = _unit_rows(left.vec) @ _unit_rows(right.vec).T
        earlier = (rt[None, :] < lt[:, None]) | ((rt[None, :] == lt[:, None]) & (ri[None, :] < li[:, None]))
        ok = earlier & (rt[None, :] >= (lt - reach)[:, None])
        n = ok.sum(1)
        best = np.where(ok, sims, -np.inf).max(1)
        hits = (ok & (sims > threshold)).sum(1)
        some = n > 0
        return pd.DataFrame({"news_id": li[some], "best": best[some], "n": n[some], "hits": hits[some]})

    return pair


def novelty(items: DataFrame, days: int = 7, threshold: float = 0.8, block: int = 2048) -> DataFrame:
    """Similarity of each item to earlier items of its ticker within ``days``.

    ``nov`` is 1 minus the largest cosine, ``n7`` the number of such items, ``simfrac``
    the share with cosine above ``threshold``; an item with none gets 1, 0, 0.

    Each (ticker, day) is dealt by hashed id into blocks of about ``block`` items, and the
    earlier items it must meet into as many blocks as they fill; a task compares one block
    with one block. A hot ticker or day becomes many such tasks instead of one large
    group, and results are combined per item by max and sum.
    """
    base = items.select("ticker", "news_id", "published_at", "vec", F.to_date("published_at").alias("day"))
    n = base.groupBy("ticker", "day").agg(F.count(F.lit(1)).alias("n"))
    met = n.select("ticker", F.explode(F.sequence("day", F.date_add("day", days))).alias("day"), F.col("n").alias("m"))
    plan = n.join(met, ["ticker", "day"]).groupBy("ticker", "day").agg(
        F.ceil(F.max("n") / block).cast("int").alias("kl"), F.ceil(F.sum("m") / block).cast("int").alias("kr"))

    def share(k: str):
        return F.pmod(F.xxhash64("news_id"), F.col(k)).cast("int")

    def every(k: str):
        return F.explode(F.sequence(F.lit(0), F.col(k) - 1))

    keys = ["ticker", "day", "bl", "br"]
    cols = [*keys, "news_id", "published_at", "vec"]
    left = base.join(plan, ["ticker", "day"]).withColumn("bl", share("kl")).withColumn("br", every("kr")).select(*cols)
    later = base.withColumn("day", F.explode(F.sequence("day", F.date_add("day", days))))
    right = later.join(plan, ["ticker", "day"]).withColumn("br", share("kr")).withColumn("bl", every("kl")).select(*cols)
    right = right.toDF(*right.columns)  # both sides come from the same rows
    fn = _compare(threshold, np.timedelta64(days, "D"))
    stats = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fn, _STATS)
    g = stats.groupBy("news_id").agg(F.max("best").alias("best"), F.sum("n").alias("n7"), F.sum("hits").alias("hits"))
    return items.drop("vec").join(g, "news_id", "left").select(
        *[c for c in items.columns if c != "vec"],
        F.coalesce(1 - F.col("best"), F.lit(1.0)).alias("nov"),
        F.coalesce("n7", F.lit(0)).alias("n7"),
        F.coalesce(F.col("hits") / F.col("n7"), F.lit(0.0)).alias("simfrac"))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """The k nearest corpus rows of each query by cosine.

    Both sides are (id, text, vec). A row whose id or text equals the query's is left
    out, and equal texts count once, with their best row. Both sides are dealt by hashed text
    into blocks of about ``block`` rows; a task compares one block with one block and returns at
    most k rows a query. Equal texts of the corpus share a block, so they are dropped before the cut.
    """
    corpus, queries = frozen(corpus.select("id", "text", "vec")), frozen(queries.select("id", "text", "vec"))
    n, m = corpus.count(), queries.count()
    kc, kq = max(1, -(-n // block)), max(1, -(-m // block))
    cols = ["id", "text", "vec"]
    left = queries.select(*cols, F.pmod(F.xxhash64("id"), F.lit(kq)).alias("bq")).withColumn(
        "bc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(kc - 1).cast("bigint"))))
    right = corpus.select(*cols, F.pmod(F.xxhash64("text"), F.lit(kc)).alias("bc")).withColumn(
        "bq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(kq - 1).cast("bigint"))))

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            c = c.sort_values("id", kind="stable")
            rid, txt = c["id"].to_numpy(), c["text"].to_numpy()
            code, _ = pd.factorize(c["text"])
            unit = _unit_rows(c["vec"])
            for qi, qt, v in zip(q["id"], q["text"], _unit_rows(q["vec"])):
                # equal vectors have equal cosines, whatever the order of additions
                sims = np.where((rid == qi) | (txt == qt), -np.inf, np.round(unit @ v, 12))
                order = np.argsort(-sims, kind="stable")  # ties by id
                first = order[np.sort(np.unique(code[order], return_index=True)[1])][:k]
                first = first[np.isfinite(sims[first])]
                out.append(pd.DataFrame({"query_id": qi, "id": rid[first], "sim": sims[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "sim": []}, dtype=object)

    qt, ct = (d.schema["id"].dataType.simpleString() for d in (queries, corpus))
    right = right.toDF(*right.columns)  # both sides may come from the same rows
    found = left.groupBy("bq", "bc").cogroup(right.groupBy("bq", "bc")).applyInPandas(pair, f"query_id {qt}, id {ct}, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "sim")
