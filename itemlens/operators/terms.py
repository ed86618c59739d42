"""Subject terms and named terms."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from itemlens import constants as K
from itemlens.functions.text import bigrams, collapse_suffix, extract_named_terms, tokenize
from itemlens.operators.counting import ranked, top_k_per_group
from itemlens.session import dealt_by_size, stored

ALL = "ALL"
LEAST, LONGEST = 3, 64  # letters of a word, and of the words that are looked for in the order of suffixes


def term_counts(items: DataFrame, group: str, subject: str, order: str, min_bigram: int = K.MIN_BIGRAM,
                stopwords: list = K.SUBJECT_STOPWORDS, weight: str | None = None) -> DataFrame:
    """(group, term, count) of the terms that stand for a group.

    Bigrams seen ``min_bigram`` times or more all stay. A single word goes when a
    kept bigram contains it, or a word seen earlier in the group does; "contains"
    means as a substring. ``order`` says which item comes first; where a row stands for
    several items, ``weight`` names their number and ``order`` is the least.

    Containment is read off the sorted suffixes of the vocabulary, see ``earliest_holders``. Texts are dealt out by their
    place into parts of bounded size, tokenised and counted once, words and pairs together; what follows works on the vocabulary, which is stored.
    """
    items = dealt_by_size(items.select(*dict.fromkeys([group, order, subject, *([weight] if weight else [])])), subject, order)
    toks = items.select(F.col(group).alias("g"), F.col(order).alias("o"), tokenize(F.col(subject), stopwords).alias("t"),
                        (F.col(weight) if weight else F.lit(1).cast("long")).alias("m"))
    terms = F.concat(
        F.transform("t", lambda w, i: F.struct(F.lit(False).alias("pair"), w.alias("w"), i.alias("p"))),
        F.transform(bigrams(F.col("t")), lambda w, i: F.struct(F.lit(True).alias("pair"), w.alias("w"), i.alias("p"))))
    kind = items.schema[order].dataType
    first = F.when(~F.col("pair"), _place(F.col("o"), F.col("p"), kind))  # of a pair nobody asks where it comes first
    counted = toks.select("g", "o", "m", F.inline(terms)).groupBy("g", "pair", "w").agg(F.sum("m").alias("n"), F.min(first).alias("first"))
    counted = counted.filter(~F.col("pair") | (F.col("n") >= min_bigram)).withColumn("first", _place_parts(F.col("first"), kind))
    counted = stored(counted, "terms")
    words = counted.filter(~F.col("pair")).select("g", "w", "n", "first")
    pairs = counted.filter("pair").select("g", "w", "n")
    # rank 0 beats every place in the text: words of kept bigrams rule out at once
    in_pair = pairs.select("g", F.explode(F.split("w", " ")).alias("w"), F.lit(0).alias("late"),
                           F.lit(None).cast(words.schema["first"].dataType).alias("first"))
    holders = words.select("g", "w", F.lit(1).alias("late"), "first").unionByName(in_pair)
    # the earliest holder counts, so each holder word is needed once per group
    holders = holders.groupBy("g", "w").agg(F.min(F.struct("late", "first")).alias("at"))
    ruled = earliest_holders(holders, words.select("g", "w"))
    singles = words.join(ruled, ["g", "w"]).filter(
        ~((F.col("at.late") == 0) | (F.col("at.first") < F.col("first")))).select("g", "w", "n")
    return pairs.unionByName(singles).select(F.col("g").alias(group), F.col("w").alias("term"), F.col("n").alias("count"))


PLACES = 10**10  # more than a text has tokens
BEFORE_ALL = str(-(1 << 63) - 1)  # stands for a null in the order, which comes first


def _place(o: Column, p: Column, kind: DataType) -> Column:
    """The place ``p`` of a text in the order ``o`` as one value that compares alike. Of whole numbers it is a number, whose least
    is kept up in a hash table; that of structs takes a sort of all rows."""
    if not isinstance(kind, IntegralType):
        return F.struct(o.alias("o"), p.alias("p"))
    text = F.coalesce(o.cast("decimal(20,0)"), F.lit(BEFORE_ALL).cast("decimal(20,0)"))
    return text * F.lit(PLACES).cast("decimal(11,0)") + p.cast("decimal(10,0)")


def _place_parts(place: Column, kind: DataType) -> Column:
    """struct(o, p) of a ``_place``."""
    if not isinstance(kind, IntegralType):
        return place
    size = F.lit(PLACES).cast("decimal(11,0)")
    p = F.pmod(place, size)
    text = ((place - p) / size).cast("decimal(20,0)")  # divides evenly
    o = F.when(text != F.lit(BEFORE_ALL).cast("decimal(20,0)"), text).cast(kind)
    return F.when(place.isNotNull(), F.struct(o.alias("o"), p.cast("int").alias("p")))


def earliest_holders(holders: DataFrame, words: DataFrame) -> DataFrame:
    """(g, w, at): for each of ``words`` (g, w) the least ``at`` of the ``holders`` (g, w, at) of its group that contain it.

    A word that another contains begins one of its suffixes, so in the order of all suffixes its holders stand right after it. The suffixes,
    one a letter of the vocabulary, are range partitioned and read once, in order, with a stack of the words that begin the
    one at hand. A word's holders may go on in the next partitions; those that do begin with the first suffix there, and
    each partition reports the least ``at`` of its leading rows for every beginning of its first suffix.
    The few words of more than ``LONGEST`` letters are looked up among substrings of their lengths, of holders as long.
    """
    suffixes = holders.where(F.length("w") >= LEAST).select("g", "w", "at", F.explode(F.sequence(F.lit(1), F.length("w") - LEAST + 1)).alias("i"))
    whole = (F.col("i") == 1) & (F.length("w") <= LONGEST)
    rows = suffixes.select("g", F.expr(f"substring(w, i, {LONGEST})").alias("s"), "at.late", F.col("at.first.o").alias("o"), F.col("at.first.p").alias("p"),
                           whole.alias("whole"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("g", "o", "p")}
    scanned = rows.repartitionByRange("g", "s").sortWithinPartitions("g", "s", F.col("whole").desc()).mapInArrow(
        _scan, f"g {kinds['g']}, w string, late int, o {kinds['o']}, p {kinds['p']}")
    at = F.struct("late", F.when(F.col("late") == 1, F.struct("o", "p")).alias("first")).alias("at")
    long = words.where(F.length("w") > LONGEST)
    lengths = long.agg(F.collect_set(F.length("w"))).scalar()
    sized = holders.where(F.length("w") > LONGEST).withColumn("_lengths", lengths).select(
        "g", "w", "at", F.explode(F.filter("_lengths", lambda k: k <= F.length("w"))).alias("k"))
    starts = F.sequence(F.lit(1), F.length("w") - F.col("k") + 1)
    parts = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("w"), i, F.col("k"))))
    found = scanned.select("g", "w", at).unionByName(sized.select("g", F.explode(parts).alias("w"), "at"))
    return found.groupBy("g", "w").agg(F.min("at").alias("at"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, w, late, o, p) from sorted suffixes (g, s, late, o, p, whole), a word before equal suffixes of others: the least place among those that it begins."""
    stack, out, first, lead, known, schema = [], [], None, None, 0, None

    def place(late, o, p):
        return (late, o is not None, o, p) if late else (0,)

    def emit(g, w, at):
        out.append((g, w, at[0], *(at[2:] if at[0] else (None, None))))

    def pop():
        g, w, at = stack.pop()
        emit(g, w, at)
        if stack:
            stack[-1][2] = min(stack[-1][2], at)

    def report(down_to):
        nonlocal known
        for k in range(known, max(down_to, LEAST - 1), -1):
            emit(first[0], first[1][:k], lead)
        known = min(known, down_to)

    def batch_out():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names=["g", "w", "late", "o", "p"])

    for batch in batches:
        kinds = [f.type for f in batch.schema]
        schema = [kinds[0], kinds[1], pa.int32(), kinds[3], kinds[4]]
        for g, s, late, o, p, whole in zip(*(c.to_pylist() for c in batch.columns)):
            at = place(late, o, p)
            while stack and not (stack[-1][0] == g and s.startswith(stack[-1][1])):
                pop()
            if whole:
                stack.append([g, s, at])
            elif stack:
                stack[-1][2] = min(stack[-1][2], at)
            if first is None:
                first, known = (g, s), len(s)
            if known >= LEAST:
                same = known if g == first[0] else 0
                while same and s[:same] != first[1][:same]:
                    same -= 1
                report(same)
                lead = at if lead is None else min(lead, at)
        if len(out) > 10_000:
            yield batch_out()
    while stack:
        pop()
    if first is not None:
        report(LEAST - 1)
        if out:
            yield batch_out()


def frequent_bigrams(items: DataFrame, subject: str, order: str, least: int = K.MIN_BIGRAM, stopwords: list = K.SUBJECT_STOPWORDS) -> DataFrame:
    """(pair, n) of the pairs of words seen ``least`` times or more. Texts are dealt out into parts of bounded size, so that the table of pairs
    that a task counts in is bounded too."""
    toks = dealt_by_size(items.select(order, subject), subject, order).select(tokenize(F.col(subject), stopwords).alias("t"))
    pairs = toks.select(F.explode(bigrams(F.col("t"))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def top_terms(items: DataFrame, subject: str, order: str, n: int = 30) -> DataFrame:
    whole = items.select(F.lit(ALL).alias("group"), subject, order)
    return ranked(term_counts(whole, "group", subject, order), "count", "term", limit=n)


def top_terms_by_group(items: DataFrame, group: str, subject: str, order: str, n: int = 12, weight: str | None = None) -> DataFrame:
    counts = term_counts(items, group, subject, order, weight=weight)
    return top_k_per_group(counts, group, [F.col("count").desc(), F.col("term")], n)


def named_term_counts(corpus: DataFrame, text: str, order: list[str], patterns: list = K.NAMED_TERM_PATTERNS,
                      suffixes: list = K.NAMED_TERM_SUFFIXES, stop_terms: list = K.NAMED_TERM_STOP,
                      dedupe: bool = False) -> DataFrame:
    """(term, count): variants that differ by a trailing suffix count together.

    The first variant seen, by ``order`` and place among the hits, gives the label.
    """
    hits = corpus.select(
        F.struct(*order).alias("o"),
        F.posexplode(extract_named_terms(F.col(text), patterns, stop_terms, dedupe=dedupe)).alias("p", "term"))
    variants = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("first"))
    return variants.groupBy(collapse_suffix(F.col("term"), suffixes).alias("key")).agg(
        F.min_by("term", "first").alias("term"), F.sum("n").alias("count")).select("term", "count")


def frequent_named_terms(counts: DataFrame, top: int = K.TOP_NAMED_TERMS, least: int = K.MIN_NAMED_TERM) -> DataFrame:
    """The top terms, then those of them seen often enough."""
    return ranked(counts, "count", "term", limit=top).filter(F.col("count") >= least)
