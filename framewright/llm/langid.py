"""Language identification by cross parsing: the language whose text explains a document in the fewest phrases."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from framewright.llm.common import chunks, process_cache


#: Bounds of the model: characters of text per language, characters of a sampled piece; entries of tables that hold every letter in
#: every state, and of all of them together (4 bytes each). What does not fit is kept as sorted edges.
TRAIN_CHARS, SAMPLE_PIECE, DENSE, ALL_DENSE = 1 << 15, 512, 1 << 23, 1 << 25
#: Phrases end every so many characters at the latest, so that the pieces of a text are parsed side by side.
LANE = 256
SEPARATOR, SPACE = 0, 1


def suffix_automaton(symbols: list[int], n_symbols: int) -> np.ndarray:
    """Rows (state, symbol, next state) of the suffix automaton of a sequence: it walks exactly the sequence's substrings."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.array([(s, c, t) for s, line in enumerate(step) for c, t in line.items() if c != SEPARATOR], np.int32).reshape(-1, 3)


class Edges:
    """The entries of a table of `Model.tables`, looked up among sorted edges instead of in an array of all letters by all states."""

    def __init__(self, edges: np.ndarray, first: np.ndarray) -> None:
        keys = edges[:, 0].astype(np.int64) * len(first) + edges[:, 1]
        order = np.argsort(keys)
        self.keys, self.next = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[edges[order, 2] + 1, 0].astype(np.int32)
        self.missing = -(first + 1)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.next[at], self.missing[keys % len(self.missing)])


class Model:
    """Suffix automata per language as edge lists; `tables` makes the arrays that parse with them."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(texts)
        letters: dict[str, int] = {}
        for pieces in texts.values():
            for piece in pieces:
                for c in piece.lower():
                    if c.isalpha():
                        letters[c] = letters.get(c, 0) + 1
        common = sorted(letters, key=lambda c: (-letters[c], c))
        self.letter = {c: i + 2 for i, c in enumerate(common)}
        self.width = len(common) + 2
        self.sizes, self.edges = [], []
        for name in self.languages:
            symbols = [s for piece in texts[name] for s in [SEPARATOR, *self.symbols(piece)]]
            self.sizes.append(max(2, len(symbols)))
            self.edges.append(suffix_automaton(symbols, self.width))

    def symbols(self, text: str) -> list[int]:
        out = []
        for c in text.lower():
            s = self.letter.get(c, SEPARATOR) if c.isalpha() else SPACE
            if s != SPACE or not out or out[-1] != SPACE:
                out.append(s)
        return out

    def tables(self) -> list[np.ndarray | Edges]:
        """Per language, next state + 1 by state and symbol; negative where a phrase ends and the next starts with the symbol."""
        out, room = [], ALL_DENSE
        for edges in self.edges:
            states = int(edges[:, [0, 2]].max()) + 1 if len(edges) else 1
            first = np.zeros(self.width, np.int32)
            root = edges[edges[:, 0] == 0]
            first[root[:, 1]] = root[:, 2]
            if states * self.width > min(DENSE, room):
                out.append(Edges(edges, first))
                continue
            room -= states * self.width
            table = np.tile(-(first + 1), (states, 1))
            table[edges[:, 0], edges[:, 1]] = edges[:, 2] + 1
            out.append(table.reshape(-1))
        return out

    def codes(self) -> np.ndarray:
        """Code point to symbol."""
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        table = np.where(alpha, SEPARATOR, SPACE).astype(np.uint8 if self.width <= 256 else np.int32)
        for c, s in self.letter.items():
            table[ord(c)] = s
        return table, alpha


def learn(labelled: DataFrame, train_chars: int = TRAIN_CHARS) -> Model:
    """Model of the languages in `labelled` (text, lang), fitted on a sample of about `train_chars` characters each.

    Pieces of 512 characters are drawn by the hash of their text and place from the distinct texts of a language, about twice
    `train_chars` of them, so long texts and copies weigh no more than their share; a language of less text gives all it has.
    Equal pieces count once. Null texts and languages are left out.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''").select("lang", "text", F.xxhash64("text").alias("h"))
    chars = rows.select("lang", "h", F.length("text").alias("n")).distinct().groupBy("lang").agg(F.sum("n").alias("chars"))
    room = F.broadcast(chars.select("lang", F.least(F.lit(1.0), 2.0 * train_chars / F.col("chars")).alias("rate")))  # a row per language
    places = F.expr(
        f"filter(sequence(0, (length(text) - 1) DIV {SAMPLE_PIECE}), i -> pmod(xxhash64(h, i, 2), {1 << 30}) < rate * {1 << 30})"
    )
    drawn = rows.join(room, "lang").select("lang", "text", F.explode(places).alias("i"))
    pieces = drawn.select("lang", F.expr(f"substring(text, i * {SAMPLE_PIECE} + 1, {SAMPLE_PIECE})").alias("piece")).distinct()
    texts: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for r in sorted(pieces.collect(), key=lambda r: (hash_of(r["piece"]), r["lang"], r["piece"])):
        if left.setdefault(r["lang"], train_chars) > 0:
            texts.setdefault(r["lang"], []).append(r["piece"][: left[r["lang"]]])
            left[r["lang"]] -= len(r["piece"])
    return Model(texts)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def parse(model: Model, tables: list[np.ndarray], codes: np.ndarray, alpha: np.ndarray, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of every text."""
    n = len(texts)
    data = "".join(f"{(t or '').lower()}\n" for t in texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(data, "<u4")
    ends = np.cumsum([len((t or "").lower()) + 1 for t in texts])
    owner = np.searchsorted(ends, np.arange(len(points)), "right")
    symbols = codes[points]
    lettered = np.bincount(owner[alpha[points]], minlength=n) > 0
    # runs of blanks are one, within a text: what stands before or after it in the batch has no part in its cost
    keep = np.r_[True, (symbols[1:] != SPACE) | (symbols[:-1] != SPACE) | (owner[1:] != owner[:-1])] if len(symbols) else np.zeros(0, bool)
    symbols, owner = symbols[keep].astype(np.int32), owner[keep]
    sizes = np.bincount(owner, minlength=n)
    firsts = np.cumsum(sizes) - sizes
    lanes = -(-sizes // LANE)
    lane_doc = np.repeat(np.arange(n), lanes)
    place = np.arange(len(lane_doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    starts = firsts[lane_doc] + place * LANE
    lengths = np.minimum(LANE, sizes[lane_doc] - place * LANE)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, lane_doc = starts[order], lengths[order], lane_doc[order]
    live = [int(np.searchsorted(-lengths, -i, "left")) for i in range(LANE)]
    cost = np.full((len(model.languages), n), np.inf)
    for k, table in enumerate(tables):
        state, phrases = np.zeros(len(starts), np.int32), np.ones(len(starts), np.int32)
        for i, m in enumerate(live):
            if not m:
                break
            step = table[state[:m] * np.int64(model.width) + symbols[starts[:m] + i]]
            phrases[:m] += step < 0
            state[:m] = np.abs(step) - 1
        cost[k] = np.bincount(lane_doc, phrases, minlength=n) * np.log2(model.sizes[k] + model.width) / np.maximum(sizes, 1)
    out = []
    for i in range(n):
        if not lettered[i] or not len(tables):
            out.append(("und", 0.0))
        else:
            ranked = np.argsort(cost[:, i], kind="stable")
            best, next_one = cost[ranked[0], i], cost[ranked[1], i] if len(ranked) > 1 else np.inf
            out.append((model.languages[ranked[0]], 1.0 if next_one == np.inf else float(next_one / (best + next_one))))
    return out


def lettered():
    """UDF: whether a text has letters, as `predictor` sees them."""

    @arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([any(map(str.isalpha, t or "")) for t in batch.to_pylist()], pa.bool_())

    return run


def predictor(model: Model):
    """UDF: text to (lang_pred, score). The score is the runner-up's cost over the sum of both: 0.5 is a tie."""

    @arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        process_cache("language")  # a worker that another stage has used lets go of what it kept
        tables, (codes, alpha) = model.tables(), model.codes()
        for batch in batches:
            out = [x for part in chunks(batch.to_pylist()) for x in parse(model, tables, codes, alpha, part)]
            yield pa.array([{"lang_pred": a, "score": b} for a, b in out], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs` (doc_id, text), from its whole text alone.

    A document is parsed greedily into the longest phrases found in each language's sample; phrases times the logarithm of
    the sample's size and the number of letters (a phrase is one of its places, or a letter it lacks), per character, is its cost, and the lowest wins (ties: the first by name). A null text, one
    without letters, or a model without languages gives `und` and 0. Case, digits and punctuation do not count.
    """
    return docs.select("doc_id", predictor(model)("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")
