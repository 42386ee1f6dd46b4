"""Near-duplicate classes: ProbMinHash signatures of word shingles, all of one weight, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import HELD, LOWER, bounded, cut, documents, slices, small, table, take_turn, text_of

#: Words of a shingle, similarity of a link, components of a signature, components of a band: at 0.8 a pair shares a band with
#: probability 0.9998.
WORDS, LEAST, COMPONENTS, ROWS = 5, 0.8, 64, 4
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


WORD_HASH: dict[bytes, int] = {}
HELD[__name__] = WORD_HASH.clear


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a text's word shingles, ascending, and their counts. Words: ASCII white space apart, A-Z lower-cased.
    Fewer words than a shingle has are one shingle; no word, no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(WORD_HASH) > 200_000:
        WORD_HASH.clear()
    for w in words:
        if w not in WORD_HASH:
            WORD_HASH[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out + h[i : len(h) - k + 1 + i])
    return np.unique(out, return_counts=True)


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash of each text: for each component the shingle that arrives there first. A shingle's arrivals are a Poisson
    process of rate 1, each at a random component; all shingles' next arrivals are drawn in turn, and a shingle ends once it comes
    later than the last first arrival of its text. So two texts agree in a component with the Jaccard similarity of their shingle
    sets, by which links are verified; weights by count would part texts that repeat a passage more or less often. Second:
    whether the text has a shingle."""
    parts = [shingles(t)[0] for t in texts]
    n = np.array([len(h) for h in parts], np.int64)
    item = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(parts)), n)
    first = np.full(len(parts) * COMPONENTS, np.inf)
    winner = np.zeros(len(parts) * COMPONENTS, np.uint64)
    time, draw = np.zeros(len(item)), 0
    while len(item):
        draw = (draw + 0x9E3779B97F4A7C15) % (1 << 64)
        r = mixed(item + np.uint64(draw))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
        last = first.reshape(-1, COMPONENTS).max(axis=1)
        on = time < last[owner]
        item, owner, time, r = item[on], owner[on], time[on], r[on]
        slot = owner * COMPONENTS + (mixed(r) % np.uint64(COMPONENTS)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = item[won]
    return winner.reshape(-1, COMPONENTS), n > 0


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of ROWS components, the band's number included."""
    s = signature.reshape(len(signature), -1, ROWS)
    out = np.broadcast_to(np.arange(s.shape[1], dtype=np.uint64), s.shape[:2])
    for i in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i])
    return out.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of distinct shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of undirected edges (a, b): label is the least node of the component. Labels spread to
    neighbours and are then replaced by their own label, until none changes; each round is cut in the shared folder."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        sent = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("string").alias("old"))
        spread = sent.union(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("mid"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        spread = cut(spread.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")))
        labels = spread.select("node", "label")
        if not spread.where("old <> label").limit(1).count():
            return labels


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of df: id, node (MD5 of the text) and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(__name__)
        for batch in batches:
            for part in slices(batch, "t"):
                sig, some = signatures(part.column("t").to_pylist())
                rows = [b.tolist() if s else [] for b, s in zip(bands(sig), some)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("node"), pa.array(rows, pa.list_(pa.int64()))], ["id", "node", "bands"])

    rows = df.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).withColumn("node", F.md5("t"))
    return bounded(rows).mapInArrow(run, "id long, node string, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' shingles are similar enough. texts: node, t, one row a node. A text joins all pairs
    that it is in; AQE splits those of a hot one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(__name__)
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            out: list[tuple[str, str]] = []
            for a, b, ta, tb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")]):
                if b not in known:
                    if len(known) > 64:
                        known.clear()
                    known[b] = shingles(tb)[0]
                if similarity(shingles(ta)[0], known[b]) >= least:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    return bounded(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")).mapInArrow(run, "a string, b string")


def differences(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, node) with n, the node's shingles, and diff, those that one of node and hub has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(__name__)
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            n, diff = [], []
            for hub, ta, tb in zip(*[batch.column(c).to_pylist() for c in ("hub", "ta", "tb")]):
                if hub not in known:
                    if len(known) > 64:
                        known.clear()
                    known[hub] = shingles(tb)[0]
                own = shingles(ta)[0]
                n.append(len(own))
                diff.append(np.setxor1d(own, known[hub], assume_unique=True).view(np.int64))
            cuts = pa.array(np.cumsum([0, *map(len, diff)]), pa.int32())
            lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([*diff, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("node"), pa.array(n, pa.int64()), lists], ["hub", "node", "n", "diff"])

    one = texts.select("node", F.col("t").alias("ta"))
    two = texts.select(F.col("node").alias("hub"), F.col("t").alias("tb"))
    rows = members.select("hub", "node").join(one, "node").join(two, "hub").select("hub", "node", "ta", "tb")
    return bounded(rows).mapInArrow(run, "hub string, node string, n long, diff array<long>")


def reference_texts(active: DataFrame) -> DataFrame:
    """(band, hub): a text that most of the bucket's texts are like. Of each bucket the most linked text is a candidate; a text
    votes for the most linked candidate of all its buckets, and a bucket's hub is what most of its texts vote for."""
    rank = F.struct("links", F.xxhash64("node", F.lit(-1)).alias("h"), "node")
    first = active.groupBy("band").agg(F.max(rank).alias("best"))
    votes = active.join(first, "band").groupBy("node").agg(F.max("best").alias("best"))
    count = active.join(votes, "node").groupBy("band", "best").agg(F.count("*").alias("n"))
    return count.groupBy("band").agg(F.max(F.struct("n", "best")).alias("b")).select("band", F.col("b.best.node").alias("hub"))


def around(active: DataFrame, texts: DataFrame, broadcast_rows: int) -> DataFrame:
    """(hub, node) of the buckets' texts, with n, their shingles, and diff, those in which they differ from R: the shingles that more
    than half of the texts held against that hub have."""
    members = active.join(reference_texts(active), "band").select("hub", "node").distinct()
    seen = table(differences(members, texts), "differences")
    often = seen.select("hub", F.explode("diff").alias("s")).groupBy("hub", "s").agg(F.count("*").alias("often")).where("often > 1")
    size = small(cut(seen.groupBy("hub").agg(F.count("*").alias("texts"))), broadcast_rows)
    # where most texts differ from their hub, it is the hub that differs from R; these are fewer than twice a text's differences
    turned = often.join(size, "hub").where(F.col("often") * 2 > F.col("texts")).groupBy("hub").agg(F.collect_list("s").alias("turned"))
    seen = seen.join(small(cut(turned), broadcast_rows // 100), "hub", "left")
    diff = F.array_union(F.array_except("diff", "turned"), F.array_except("turned", "diff"))
    return table(seen.select("hub", "node", "n", F.when(F.col("turned").isNull(), F.col("diff")).otherwise(diff).alias("diff")), "seen")


def slack_of(size: Column, n: Column, least: float) -> Column:
    """How much more a text of n shingles differs from R than its share of what two similar texts may differ by. Texts x and y are
    similar enough if they differ in at most (1 - least) / (1 + least) of |x| + |y| shingles, and differ in no more than both do
    from R together: so if their slacks sum to 0 or less they are similar for certain, and each of them is so to the text of least slack."""
    return size - n * ((1 - least) / (1 + least))


def prefixes(seen: DataFrame, least: float) -> DataFrame:
    """hub, s, node, label, centre, n, size and rank: of each text's differences from R those by which it can meet a similar text of
    another label. seen: as from around(), with label, and centre, the label of the text of least slack around the hub, which all texts
    were held against.

    What x and y differ in is what only one of their differences from R has. So x and y, similar enough and of different labels, have
    at least half of their slacks' sum, which is above 0, of their differences in common; and one of these is among the rarest that x
    has, all but that many less one, and of y alike. In any case x needs its size less (1 - least) / least of n in common."""
    each = seen.select("hub", "node", F.explode("diff").alias("s"))
    often = each.groupBy("hub", "s").agg(F.count("*").alias("often")).where("often > 1")
    size = seen.select("hub", "node", "n", "label", "centre", F.size("diff").cast("long").alias("size"))
    own = Window.partitionBy("hub", "node")
    # shingles in which no other text differs come first in the order; they are counted and left out
    rank = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "s"))
    shared = F.greatest(F.lit(1), F.ceil(F.col("size") - F.col("n") * ((1 - least) / least) - 1e-9))
    rows = each.join(often, ["hub", "s"]).join(size, ["hub", "node"]).withColumn("rank", rank)
    return table(rows.where(F.col("rank") <= F.col("size") - shared + 1).select("hub", "s", "node", "label", "centre", "n", "size", "rank"), "prefixes")


def pairs_of(prefix: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of texts of different labels, one of them not of the centre's, that meet in (hub, s) and can be similar enough."""
    side = lambda df, x: df.select(F.col("hub").alias(f"{x}hub"), F.col("s").alias(f"{x}s"), *[F.col(c).alias(f"{x}{c}") for c in ("node", "label", "n", "size", "rank")])
    left, right = side(prefix.where("label <> centre"), "x"), side(prefix, "y")
    sum_ = slack_of(F.col("xsize"), F.col("xn"), least) + slack_of(F.col("ysize"), F.col("yn"), least)
    shared = F.greatest(F.lit(1), F.ceil(sum_ / 2 - 1e-9))
    can = (F.col("xrank") <= F.col("xsize") - shared + 1) & (F.col("yrank") <= F.col("ysize") - shared + 1)
    both = left.join(right, (F.col("xhub") == F.col("yhub")) & (F.col("xs") == F.col("ys")) & (F.col("xlabel") != F.col("ylabel")) & can)
    return both.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()


def neighbour_labels(edges: DataFrame) -> DataFrame:
    """(node, new, links): the most linked of a node and its neighbours, and how many neighbours it has. Nodes with the same label
    are neighbours of one node, and so in one class."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    links = both.groupBy("a").agg(F.count("*").alias("links"))
    near = both.join(links.withColumnsRenamed({"a": "b", "links": "l"}), "b").select("a", "b", "l", F.lit(0).cast("long").alias("own"))
    near = near.union(links.select("a", F.col("a").alias("b"), F.col("links").alias("l"), F.col("links").alias("own")))
    return near.groupBy("a").agg(F.max(F.struct("l", "b")).alias("m"), F.max("own").alias("links")).select(F.col("a").alias("node"), F.col("m.b").alias("new"), "links")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, pivot_rounds: int = 1, broadcast_rows: int = 250_000, most: int = 2000, levels: int = 8) -> DataFrame:
    """id, node (MD5 of the text) and class_id of each row: the least id of its class. Rows are in one class if their texts are
    equal or linked by a chain of texts whose shingle sets have Jaccard similarity of at least `least`.

    Equal texts count once from the start. Texts that share a band are candidates. A bucket of a band isn't multiplied out:
    in each round one of its texts, of those not tried there the one with the most links so far, is compared with its texts of
    other labels; buckets of one label are done. What is left is held against R, what most of the bucket's texts have in common, and
    all against the text nearest to R. Two texts that can still be similar, and aren't known to be in one class, then have one of their
    rarest differences from R in common (prefixes()). Where at most `most` texts meet in a difference they are paired; more of them are
    a bucket of their own, with an R of its own, of which that difference is a part: for so many levels, the last of which pairs all. No
    link is lost, and pairs grow with the texts, not with the square of a group. Classes are the components of all links.

    Null text is the empty text; texts without a word are linked to equal texts alone. Null ids are a class id only if no other
    is there. Rows equal in id and text get the same result. An empty table gives an empty table."""
    spark = df.sparkSession
    rows = table(signed(df, key, text), "signatures")
    nodes = rows.groupBy("node").agg(F.first("bands").alias("bands"))
    member = nodes.select("node", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    active = table(member.join(shared, "band").select("band", "node", F.col("node").alias("label"), F.lit(0).cast("long").alias("links"), F.lit(False).alias("used")), "members")
    wanted = table(active.select("node").distinct(), "wanted")
    docs = df.select(text_of(text).alias("t")).withColumn("node", F.md5("t"))
    texts = table(docs.join(small(wanted, broadcast_rows), "node", "left_semi").groupBy("node").agg(F.first("t").alias("t")), "texts")
    edges = spark.createDataFrame([], "a string, b string")
    for turn in range(pivot_rounds):
        rank = F.struct("links", F.xxhash64("node", F.lit(turn)), "node", "label")
        pivot = active.groupBy("band").agg(F.max(F.when(~F.col("used"), rank)).alias("p")).where("p is not null").select("band", F.col("p.node").alias("b"), F.col("p.label").alias("other"))
        active = table(active.join(pivot, "band", "left"), "tried")
        pairs = active.where("label <> other").select(F.col("node").alias("a"), "b").distinct()
        edges = edges.union(table(verified(pairs, texts, least), "links"))
        active = active.join(neighbour_labels(edges).withColumnRenamed("links", "more"), "node", "left")
        active = active.select("band", "node", F.coalesce("new", "label").alias("label"), F.coalesce("more", "links").alias("links"), (F.col("used") | F.coalesce(F.col("node") == F.col("b"), F.lit(False))).alias("used"))
        split = active.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
        active = table(active.join(split, "band"), "members")
    for level in range(levels):
        seen = around(active, texts, broadcast_rows)
        nearest = F.struct(slack_of(F.size("diff").cast("double"), F.col("n"), least), "node")
        centre = cut(seen.groupBy("hub").agg(F.min_by("node", nearest).alias("b")))
        pairs = seen.select("hub", "node").join(small(centre, broadcast_rows), "hub").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
        if level:  # labels are known by then
            of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}label"))
            pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("not (alabel <=> blabel) or alabel is null").select("a", "b")
        edges = edges.union(table(verified(pairs, texts, least), "links"))
        labels = table(components(edges), "labels")
        seen = seen.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        of = centre.join(labels, centre["b"] == labels["node"], "left").select("hub", F.coalesce("label", "b").alias("centre"))
        prefix = prefixes(seen.join(small(cut(of), broadcast_rows), "hub"), least)
        group = prefix.groupBy("hub", "s").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        group = table(group.select("hub", "s", (F.lit(level + 1 < levels) & (F.col("n") > most)).alias("again")), "groups")
        meet = prefix.join(group, ["hub", "s"])
        late = table(verified(table(pairs_of(meet.where("not again"), least), "pairs"), texts, least), "links")
        edges = edges.union(late)
        if not group.where("again").limit(1).count():
            break
        active = meet.where("again").select(F.xxhash64("hub", "s").alias("band"), "node", "label", (-F.col("size")).alias("links"))
    labels = table(components(edges), "labels")
    ids = rows.groupBy("node").agg(F.min("id").alias("least_id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = table(ids, "classes")
    ids = ids.join(ids.groupBy("label").agg(F.min("least_id").alias("class_id")), "label").select("node", "class_id")
    return rows.select("id", "node").join(ids, "node").select("id", "node", "class_id")


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 250_000) -> DataFrame:
    """The rows of df that stay: of each class the row with the least id (null last; ties by MD5 of the text); of rows equal in
    both, one. Columns are df's."""
    found = table(classes(df, key, text), "classes")
    order = F.struct(F.col("id").isNull(), "id", "node")
    first = found.groupBy("class_id").agg(F.min(order).alias("f")).select("class_id", F.col("f.id").alias("fid"), F.col("f.node").alias("fnode"))
    kept = found.join(first, found["class_id"].eqNullSafe(first["class_id"])).select("id", "node", (F.col("id").eqNullSafe(F.col("fid")) & (F.col("node") == F.col("fnode"))).alias("stays"))
    kept = table(kept, "kept")
    gone = kept.where("not stays").select(F.col("id").alias("__i"), F.col("node").alias("__m")).distinct()
    rows = df.withColumns({"__m": F.md5(text_of(text)), "__i": F.col(key).cast("long")})
    gone = small(gone.withColumn("__g", F.struct("__i", "__m")).select("__g"), broadcast_rows)
    rows = rows.withColumn("__g", F.struct("__i", "__m")).join(gone, "__g", "left_anti").drop("__g")
    if kept.where("stays").groupBy("id", "node").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["__i", "__m"])
    return rows.drop("__m", "__i")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id")
