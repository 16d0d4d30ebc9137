"""Personal data: spans by form, and information-theoretic sanitisation of terms that give a protected entity away."""

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from framewright.llm.common import scan
from framewright.session import cut

KINDS = ("email", "ip", "card", "phone")
#: Words of context on either side of an entity; disclosure at which a term is hidden; letters of a term that are kept when it
#: is generalised; smoothing of ties: those shown by `shown` distinct contexts count shown / (shown + SMOOTH).
REACH, DISCLOSURE, STEM, SMOOTH = 8, 0.8, 3, 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start: leftmost non-overlapping matches per kind that pass its test."""
    out = [(0, s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CHAIN.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in CALL.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entity(kind: int, found: str) -> str:
    """One name for all ways to write the same protected value."""
    plain = found.lower() if kind < 2 else re.sub(r"[^0-9]", "", found)
    return f"{KINDS[kind]}:{plain}"


def merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """What the spans cover, as stretches in order that do not meet."""
    covered: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    return covered


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For every span, the words round it that are in no span themselves."""
    covered = merged(spans)
    starts = [s for s, _ in covered]

    def free(m) -> bool:
        i = bisect_left(starts, m.end())  # the stretches before this one begin before the word ends
        return i == 0 or covered[i - 1][1] <= m.start()

    out = []
    for kind, start, end in spans:
        low, high = max(0, start - 40 * REACH), min(len(text), end + 40 * REACH)
        while low > 0 and text[low - 1].isalpha():
            low -= 1
        while high < len(text) and text[high].isalpha():
            high += 1
        before = [m for m in WORD.finditer(text, low, start) if free(m)][-REACH:]
        after = [m for m in WORD.finditer(text, end, high) if free(m)][:REACH]
        words = [{"term": m[0].lower(), "start": m.start(), "end": m.end()} for m in before + after]
        out.append({"entity": entity(kind, text[start:end]), "words": words})
    return out


def vocabulary(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Every term of the text with the starts and ends, in turn, of its places that are in no span."""
    found: dict[str, list[int]] = {}
    covered, i = merged(spans), 0
    for m in WORD.finditer(text):
        s, e = m.span()
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        if i == len(covered) or covered[i][0] >= e:
            found.setdefault(m[0].lower(), []).extend((s, e))
    return [{"term": t, "at": at} for t, at in found.items()]


SCANNED = (
    "doc_id bigint, key string, spans array<struct<kind:int,start:bigint,end:bigint>>, "
    "contexts array<struct<entity:string,words:array<struct<term:string,start:bigint,end:bigint>>>>, "
    "words array<struct<term:string,at:array<bigint>>>, term string, times bigint"
)
#: Words of texts with entities that a worker holds before it hands them on.
HELD_WORDS = 200_000


def scanned(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row per document with its spans, contexts and, if it has any, words, and word counts of each task (term, times)."""

    def make():
        counts: Counter = Counter()

        def totals() -> Iterator[dict]:
            if counts:
                nothing = [None] * len(counts)
                yield {"doc_id": nothing, "key": nothing, "spans": nothing, "contexts": nothing, "words": nothing, "term": list(counts), "times": list(counts.values())}
                counts.clear()

        def work(ids, keys, texts):
            spans, around, words, begin, size = [], [], [], 0, 0
            for i, text in enumerate(texts):
                found = base_spans(text) if text else []
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                around.append(contexts(text, found) if found else [])
                words.append(vocabulary(text, found) if found else [])
                size += sum(len(w["at"]) // 2 for w in words[-1])
                if text:
                    counts.update(WORD.findall(text.lower()))
                    if len(counts) > 400_000:
                        yield from totals()
                if size > HELD_WORDS or i == len(texts) - 1:
                    nothing = [None] * len(spans)
                    yield {"doc_id": ids[begin : i + 1], "key": keys[begin : i + 1], "spans": spans, "contexts": around, "words": words, "term": nothing, "times": nothing}
                    spans, around, words, begin, size = [], [], [], i + 1, 0

        work.flush = totals
        return work

    return scan(docs.select("doc_id", F.coalesce(F.md5("text"), F.lit("")).alias("key"), "text"), SCANNED, make)


def revealing(rows: DataFrame, disclosure: float = DISCLOSURE, smooth: float = SMOOTH) -> DataFrame:
    """(entity, term, stem) of the terms that reveal an entity; stem is null where even the stem does.

    Over the word positions of the corpus, a term's pointwise mutual information with an entity's contexts is divided by the
    information of being in one of them: 1 if the term occurs nowhere else, 0 if the two are independent. Every occurrence
    in the corpus counts. What a pair was seen together is taken by the part shown / (shown + smooth), where equal contexts show a tie once,
    so that a tie seen once weighs less than the same tie seen often.
    """
    words = rows.where("term IS NOT NULL").groupBy("term").agg(F.sum("times").alias("n"))
    words = cut(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    near = rows.where("size(contexts) > 0").select(F.explode("contexts").alias("c"))
    near = near.select("c.entity", F.col("c.words.term").alias("terms"), F.xxhash64("c.words.term").alias("context"))
    sizes = near.groupBy("entity").agg(F.sum(F.size("terms")).alias("n_entity"))
    pairs = near.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("shown"))
    stemmed = lambda c: F.substring(c, 1, STEM)
    both = F.col("n_both") * F.col("shown") / (F.col("shown") + F.lit(float(smooth)))
    level = lambda n: F.log(both * F.lit(float(total)) / (F.col("n_entity") * n)) / F.log(F.lit(float(total)) / F.col("n_entity"))
    known = cut(pairs.join(sizes, "entity").where(F.col("n_entity") < total).join(words, "term"))
    hidden = known.where(level(F.col("n")) >= disclosure).select("entity", "term")
    stems = pairs.groupBy("entity", stemmed("term").alias("stem")).agg(F.sum("n_both").alias("n_both"), F.max("shown").alias("shown")).join(sizes, "entity")
    wanted = hidden.select(stemmed("term").alias("stem")).distinct()
    stem_words = words.withColumn("stem", stemmed("term")).join(wanted, "stem", "left_semi").groupBy("stem").agg(F.sum("n").alias("n_stem"))
    safe = stems.join(stem_words, "stem").where(level(F.col("n_stem")) < disclosure).select("entity", "stem")
    hidden = hidden.withColumn("stem", stemmed("term")).alias("h")
    kept = hidden.join(safe.alias("s"), (F.col("h.entity") == F.col("s.entity")) & (F.col("h.stem") == F.col("s.stem")), "left")
    return kept.select("h.entity", "h.term", F.col("s.stem").alias("stem"))


def find(docs: DataFrame, disclosure: float = DISCLOSURE, smooth: float = SMOOTH) -> DataFrame:
    """(doc_id, key, spans, terms) for every row of `docs` (doc_id, text).

    spans: (kind number, start, end) of the four forms. terms: (start, end, stem) of words that reveal an entity of the same text,
    wherever in it they stand; texts without the entity keep them. stem is what a generalised term keeps, null where the term goes altogether. Offsets are code points.
    A null or empty text has neither. Repeated rows are repeated, no rows give none, other columns are ignored. key is the
    MD5 of the text: equal texts have equal findings.
    """
    rows = cut(scanned(docs))
    own = rows.where("key IS NOT NULL")
    near = own.where("size(contexts) > 0").dropDuplicates(["key"])
    held = near.select("key", F.explode("contexts.entity").alias("entity")).distinct()
    words = near.select("key", F.explode("words").alias("w")).select("key", "w.term", "w.at")
    told = words.join(cut(revealing(rows, disclosure, smooth)), "term").join(held, ["key", "entity"], "left_semi")
    each = told.groupBy("key", "term").agg(F.first("at").alias("at"), F.min("stem").alias("stem"), F.count_if(F.col("stem").isNull()).alias("bare"))
    each = each.withColumn("stem", F.when(F.col("bare") == 0, F.col("stem")))
    places = F.expr("transform(sequence(0, size(at) DIV 2 - 1), i -> struct(at[2 * i] AS start, at[2 * i + 1] AS end, stem AS stem))")
    terms = each.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list(places))).alias("terms"))
    return own.join(terms, "key", "left").select("doc_id", "key", "spans", F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,stem:string>>")).alias("terms"))


def cleaner():
    @arrow_udf("string")
    def run(text: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, terms in text:
            out = []
            for t, hidden in zip(texts.to_pylist(), terms.to_pylist()):
                cover = [(s, e, f"[{KINDS[k].upper()}]") for k, s, e in base_spans(t)] if t else []
                cover += [(h["start"], h["end"], f"{h['stem']}*" if h["stem"] else "") for h in hidden or []]
                parts, done = [], 0
                for s, e, instead in sorted(cover):
                    if s >= done:
                        parts += [t[done:s], instead]
                    done = max(done, e)
                out.append(None if t is None else "".join([*parts, t[done:]]))
            yield pa.array(out, pa.string())

    return run


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, smooth: float = SMOOTH) -> DataFrame:
    """(doc_id, text) with entities replaced by their kind and revealing terms generalised to their stem or removed."""
    found = find(docs, disclosure, smooth).where("size(terms) > 0").dropDuplicates(["key"]).select("key", "terms")
    keyed = docs.select("doc_id", "text", F.coalesce(F.md5("text"), F.lit("")).alias("key"))
    return keyed.join(found, "key", "left").select("doc_id", cleaner()("text", "terms").alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text, one row per document."""
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    base = f"array_join(transform(spans, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"
    extra = "array_join(transform(terms, s -> concat('term:', s.start, ':', s.end)), ',')"
    return find(docs).select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(spans, s -> s.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.expr(f"sha2({base}, 256)").alias("base_sha256"),
        F.expr(f"concat({base}, CASE WHEN size(spans) > 0 AND size(terms) > 0 THEN ',' ELSE '' END, {extra})").alias("spans"),
    )
