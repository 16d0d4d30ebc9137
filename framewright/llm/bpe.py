"""BPE encoding and decoding equal to the tokenizers library's, with long texts encoded in parallel pieces."""

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from framewright.llm.common import chunks, process_cache, scan
from framewright.llm.word_ids import WordIds

#: Texts of more characters are cut into pieces of at most PIECE.
LONG, PIECE = 1 << 15, 1 << 14
#: A match at the edge of a piece can depend on so many characters beyond it (contractions such as 'll).
REACH = 4


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def namer(tokenizer):
    """Function from a list of ids to the text that the library decodes them to, special tokens kept."""
    if tokenizer.decoder is None:
        names = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        return lambda ids: " ".join(map(names.__getitem__, ids))
    return lambda ids: tokenizer.decode(ids, skip_special_tokens=False)


def short_coder(path: str, decoded: bool, bits: int):
    """UDF: text to its ids and, if asked for, what they decode to."""
    fields = [("ids", pa.binary()), ("decoded", pa.string())]

    @arrow_udf("struct<ids:binary,decoded:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = WordIds.kept(path, joined=False, bits=bits)
        name = namer(words.tokenizer)
        for batch in batches:
            ids = [i for part in chunks(batch.to_pylist()) for i in words.encode(part)]
            text = [name(np.frombuffer(b, "<u4").tolist()) if decoded else None for b in ids]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(text, pa.string())], fields=[pa.field(*f) for f in fields])

    return run


class Pieces:
    """Encoding of pieces of normalised text, and the exact join of two neighbours."""

    def __init__(self, path: str, whole=None) -> None:
        self.whole, self.plain = whole or load(path), load(path)
        self.plain.normalizer = None
        self.plain.encode_special_tokens = True
        self.name = namer(self.whole)
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.any_special = re.compile("|".join(map(re.escape, longest_first)) or "(?!)")

    @classmethod
    def kept(cls, path: str) -> "Pieces":
        cache = process_cache("tokens")
        words = cache.get(("word_ids", path))  # its tokenizer serves both
        return cache.get(("pieces", path)) or cache.setdefault(("pieces", path), cls(path, words and words.tokenizer))

    def sections(self, text: str) -> Iterator[tuple[str, int]]:
        """Normalised text between special tokens (with -1), and the ids of these."""
        at = 0
        for found in [*self.any_special.finditer(text), None]:
            stop = found.start() if found else len(text)
            if stop > at:
                part = text[at:stop]
                yield (self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part), -1
            if found:
                yield "", self.special[found[0]]
                at = found.end()

    def encode(self, text: str) -> np.ndarray:
        """Rows (id, start, end) in characters."""
        e = self.plain.encode(text, add_special_tokens=False)
        return np.column_stack([np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)]) if e.ids else np.zeros((0, 3), np.int64)

    def join(self, a: str, left: np.ndarray, b: str, right: np.ndarray) -> np.ndarray:
        """The tokens of a + b, from the tokens of both.

        A window of tokens round the join is encoded anew and grows until it agrees with both sides: its first token is the
        left side's at the same place, and a token well inside it is the right side's. A sequence of BPE tokens is the
        encoding of its text exactly if each two neighbours are, and every two neighbours of the result stand next to
        each other in one of the three encodings. Where no agreement comes, the window is all of the text.
        """
        text, shift, near = a + b, len(a), 8
        right = right + np.array([0, shift, shift])
        while True:
            i, j = max(0, len(left) - near), min(len(right), near)
            start, end = (int(left[i, 1]) if i else 0), (int(right[j - 1, 2]) if j < len(right) else len(text))
            near *= 2
            window = self.encode(text[start:end]) + np.array([0, start, start])
            if i and not self.starts_alike(text, left, i, window, len(a)):
                continue
            if j == len(right):
                return np.concatenate([left[:i], window])
            meeting = self.meeting(window, right[:j], shift, end)
            if meeting:
                return np.concatenate([left[:i], window[: meeting[0] + 1], right[meeting[1] + 1 :]])

    @staticmethod
    def starts_alike(text: str, left: np.ndarray, i: int, window: np.ndarray, end: int) -> bool:
        clean = left[i, 1] >= left[i - 1, 2] and left[i, 2] <= end - REACH and (i + 1 == len(left) or left[i + 1, 1] >= left[i, 2])
        return bool(clean and len(window) > 1 and (window[0] == left[i]).all() and text[left[i, 1]] != "'")

    @staticmethod
    def meeting(window: np.ndarray, right: np.ndarray, begin: int, end: int) -> tuple[int, int] | None:
        """Positions of the last token that both have, whole and away from the edges of the window."""
        ends = {tuple(t): k for k, t in enumerate(right.tolist()) if t[1] >= begin and (k + 1 == len(right) or right[k + 1, 1] >= t[2])}
        for k in range(len(window) - 2, -1, -1):
            t = tuple(window[k].tolist())
            if t[2] <= end - REACH and t in ends and window[k + 1, 1] >= t[2] and (k == 0 or window[k - 1, 2] <= t[1]):
                return k, ends[t]
        return None

    def tree(self, pieces: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Join neighbours pairwise until one is left."""
        while len(pieces) > 1:
            pairs = [pieces[i : i + 2] for i in range(0, len(pieces), 2)]
            pieces = [(p[0][0] + p[1][0], self.join(*p[0], *p[1])) if len(p) == 2 else p[0] for p in pairs]
        return pieces[0][1]


def encode_long(docs: DataFrame, path: str, piece: int, decoded: bool) -> DataFrame:
    """(doc_id, ids, decoded) of texts that are cut into pieces: one shuffle spreads the pieces, one gathers those of a text."""

    def cutter():
        codec = Pieces.kept(path)

        def work(rows, ids, texts):
            for row, doc_id, text in zip(rows, ids, texts):
                out = {k: [] for k in ("row", "doc_id", "part", "piece", "text", "id")}
                for part, (section, special) in enumerate(codec.sections(text)):
                    for n, i in enumerate(range(0, max(1, len(section)), piece)):
                        for k, v in zip(out, (row, doc_id, part, n, section[i : i + piece], special)):
                            out[k].append(v)
                yield out

        return work

    def leaves():
        codec = Pieces.kept(path)

        def work(rows, ids, parts, pieces, texts, specials):
            tokens = [codec.encode(t) if s < 0 else np.array([[s, 0, 0]]) for t, s in zip(texts, specials)]
            yield dict(row=rows, doc_id=ids, part=parts, piece=pieces, text=texts, tokens=[t.astype("<i4").tobytes() for t in tokens])

        return work

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        codec, out = Pieces.kept(path), []
        pdf = pdf.sort_values(["part", "piece"])
        for _, part in pdf.groupby("part", sort=True):
            out.append(codec.tree([(t, np.frombuffer(k, "<i4").reshape(-1, 3).astype(np.int64)) for t, k in zip(part["text"], part["tokens"])])[:, 0])
        ids = np.concatenate(out).astype("<u4")
        text = codec.name(ids.tolist()) if decoded else None
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1].astype("Int64"), "ids": [ids.tobytes()], "decoded": [text]})

    head = "row bigint, doc_id bigint, part int, piece int, text string"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    spread = scan(rows, f"{head}, id bigint", cutter).repartition(tasks, "row", "part", "piece")
    return scan(spread, f"{head}, tokens binary", leaves).groupBy("row").applyInPandas(gather, "doc_id bigint, ids binary, decoded string")


def code(docs: DataFrame, path: str, decoded: bool = True, long: int = LONG, piece: int = PIECE, bits: int = 20) -> DataFrame:
    """(doc_id, ids, decoded) for every row of `docs` (doc_id, text): ids as `encode` gives them, and the text they decode to.

    A worker remembers up to two thirds of 2**`bits` words.
    """
    rows = docs.select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(size <= long).select("doc_id", short_coder(path, decoded, bits)("text").alias("c")).select("doc_id", "c.ids", "c.decoded")
    return short.unionByName(encode_long(rows.where(size > long), path, piece, decoded))


def encode(docs: DataFrame, path: str, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids) for every row of `docs` (doc_id, text): the library's ids as little-endian unsigned 32-bit integers.

    For tokenizers that drop white space between words. Texts of more than `long` characters are cut into pieces that are
    encoded in parallel and joined as a tree, each join re-encoding a growing window round it until both sides agree.
    A null or empty text has no ids; repeated rows are repeated; other columns are ignored; no rows give none.
    """
    return code(docs, path, False, long, piece).select("doc_id", "ids")


def decoder(path: str):
    """UDF: ids (as `encode` gives them) to text, as the library decodes them with special tokens kept."""

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text = namer(load(path))
        for batch in batches:
            yield pa.array([None if b is None else text(np.frombuffer(b, "<u4").tolist()) for b in batch.to_pylist()], pa.string())

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of every row of `encoded` (doc_id, ids); null ids give null."""
    return encoded.select("doc_id", decoder(path)("ids").alias("decoded"))


def digest(docs: DataFrame, path: str, bits: int = 20) -> DataFrame:
    """Token count and the hashes of ids and decoded text, one row per document."""
    return code(docs, path, bits=bits).select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
