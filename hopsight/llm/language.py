"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. An n-gram's vector binds
those of its letters: the product of the vectors, each rotated by its place. A document bundles
(adds) its n-grams, a language the unit vectors of its documents; a document gets the language whose
prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import read
from .words import pieces, texts

DIM, GRAM = 1024, 3
#: Labelled documents of each language that its prototype is learned from, in expectation; languages at most.
TRAIN_DOCS, MAX_LANGS = 5_000, 1000
#: A language's sum holds unit vectors in this fixed-point scale, so that it is the same in any order.
SCALE = 1 << 20
#: Text of a piece, cells of a piece's count matrix, n-grams bound at once.
PIECE, CELLS, BOUND = 1 << 20, 1 << 22, 1 << 13

UNKNOWN = "und"
#: A text of fewer letters is too short to be told from chance: it needs this cosine only.
SHORT_LETTERS, MIN_SCORE = 30, 0.02
#: Any other text needs a larger cosine than all of so many texts of so many random words in its language's letters,
#: each letter that makes up this share of the language at least.
CHANCE_TEXTS, CHANCE_WORDS, LETTER_SHARE = 400, 200, 0.001


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def _letter(code: int) -> np.ndarray:
    return (np.random.default_rng(code).integers(0, 2, DIM, np.int8) * 2 - 1).astype(np.int8)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters of all texts, each run of anything else and each text's ends as one 0; each one's row."""
    column = pc.binary_join_element_wise("", pc.utf8_lower(column.fill_null("")), "", "\n")
    n = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data, at = texts(column)
    codes = np.frombuffer(data[at[0]:at[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    codes = codes * _is_letter()[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (row[1:] != row[:-1])
    return codes[keep], row[keep]


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters used (0 first), each n-gram's code in base of their number, and its row."""
    codes, row = _letters(column)
    seen = np.zeros(0x110000, np.int64)
    seen[codes], seen[0] = 1, 1
    used = np.flatnonzero(seen)
    seen[used] = np.arange(len(used))
    index = seen[codes]
    n = len(index) - GRAM + 1
    if n <= 0:
        return used, np.empty(0, np.int64), np.empty(0, np.int64)
    gram = np.zeros(n, np.int64)
    for i in range(GRAM):
        gram = gram * len(used) + index[i:i + n]
    inside = (row[:n] == row[GRAM - 1:]) & ((index[:n] != 0) | (index[1:n + 1] != 0))
    return used, gram[inside], row[:n][inside]


def profiles(column: pa.Array) -> np.ndarray:
    """(rows, DIM): the bundled n-gram vectors of each text; zero for a text without letters."""
    out = np.zeros((len(column), DIM), np.float32)
    used, gram, row = _grams(column)
    if not len(gram):
        return out
    space = len(used) ** GRAM
    if space <= 1 << 24:
        grams = np.flatnonzero(np.bincount(gram, minlength=space))
        place = np.zeros(space, np.int32)
        place[grams] = np.arange(len(grams))
        place = place[gram]
    else:
        grams, place = np.unique(gram, return_inverse=True)
    letters = np.stack([_letter(int(c)) for c in used])
    rotated = [np.roll(letters, GRAM - 1 - i, axis=1) for i in range(GRAM)]
    for lo in range(0, len(grams), BOUND):
        now, rest = grams[lo:lo + BOUND], None
        bound, code = np.ones((len(now), DIM), np.int8), now
        for i in range(GRAM - 1, -1, -1):
            code, rest = np.divmod(code, len(used))
            bound *= rotated[i][rest]
        bound = bound.astype(np.float32)
        step = max(1, CELLS // len(now))
        inside = (place >= lo) & (place < lo + len(now))
        p, r = place[inside] - lo, row[inside]
        for top in range(0, len(column), step):
            rows = min(step, len(column) - top)
            mine = (r >= top) & (r < top + rows)
            counts = np.bincount((r[mine] - top) * len(now) + p[mine], minlength=rows * len(now))
            out[top:top + rows] += counts.reshape(rows, len(now)).astype(np.float32) @ bound
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, at, x): the sums of each language's unit vectors, and from DIM on how often each letter occurs."""
    sums: dict[str, np.ndarray] = {}
    letters: dict[str, np.ndarray] = {}
    for piece in pieces(batches, "text", PIECE):
        scaled = np.rint(_units(profiles(piece.column("text"))) * SCALE).astype(np.int64)
        langs = np.array(piece.column("lang").to_pylist(), object)
        codes, row = _letters(piece.column("text"))
        for lang in set(langs):
            mine = langs == lang
            sums[lang] = sums.get(lang, 0) + scaled[mine].sum(axis=0)
            letters[lang] = letters.get(lang, 0) + np.bincount(codes[mine[row]], minlength=0x110000)
    for lang in sums:
        letters[lang][0] = 0
        used = np.flatnonzero(letters[lang])
        at, x = np.concatenate([np.arange(DIM), DIM + used]), np.concatenate([sums[lang], letters[lang][used]])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x)], names=["lang", "at", "x"])


def chance(prototype: np.ndarray, letters: list[str]) -> float:
    """The largest cosine of `prototype` with texts of random words in `letters`."""
    if not letters:
        return MIN_SCORE
    rng = np.random.default_rng(len(letters))
    made = []
    for _ in range(CHANCE_TEXTS):
        lengths = rng.integers(2, 10, CHANCE_WORDS)
        drawn = iter(rng.choice(letters, int(lengths.sum())).tolist())
        made.append(" ".join("".join(next(drawn) for _ in range(n)) for n in lengths.tolist()))
    return max(MIN_SCORE, float((_units(profiles(pa.array(made))) @ prototype).max()))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Languages, their prototypes (unit rows) and their usual letters, from docs (doc_id, text, lang).

    Rows with a null text or lang are left out. A hash of the id picks `train_docs` of each language in
    expectation, all of a language that has fewer, so every language is learned at any size of the table.
    """
    spark = docs.sparkSession
    fit = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counted = fit.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(counted) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    shares = spark.createDataFrame([(r["lang"], int(np.ceil(min(1.0, train_docs / r["n"]) * 1_000_000))) for r in counted], "lang string, upto int")
    picked = fit.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("upto"))
    sums = (picked.select("lang", "text").mapInArrow(_sums, "lang string, at int, x long")
            .groupBy("lang", "at").agg(F.sum("x").alias("x")).collect())
    names = sorted({r["lang"] for r in sums})
    index, out, letters = {n: i for i, n in enumerate(names)}, np.zeros((len(names), DIM)), [{} for _ in names]
    for r in sums:
        if r["at"] < DIM:
            out[index[r["lang"]], r["at"]] = r["x"]
        else:
            letters[index[r["lang"]]][chr(r["at"] - DIM)] = r["x"]
    usual = [sorted(c for c, n in found.items() if n >= LETTER_SHARE * sum(found.values())) for found in letters]
    return names, _units(out), usual


def _predict(names: list[str], prototypes: np.ndarray, drop: str | None) -> Callable:
    """Adds the language, the score and the number of letters to the columns but `drop`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            vectors = profiles(piece.column("text"))
            known = vectors.any(axis=1)
            cosine = _units(vectors) @ prototypes.T if names else np.zeros((len(vectors), 1))
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(best)), best], 0, 1) * known
            lang = [names[b] if k and names else UNKNOWN for b, k in zip(best, known, strict=True)]
            kept = [c for c in piece.schema.names if c != drop]
            codes, row = _letters(piece.column("text"))
            letters = np.bincount(row[codes > 0], minlength=len(vectors))
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letters)],
                                             names=[*kept, "_lang_pred", "_lang_score", "_lang_letters"])
    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, lang_pred, score (the cosine, 0 if negative).

    `labelled` (doc_id, text, lang) is learned from. A null text and one without letters are 'und' with
    score 0, as are all if no language is learned. Of equal cosines the first language in code point
    order wins. Repeated rows and null ids are predicted like any; empty tables give no rows; other
    columns are not looked at.
    """
    names, prototypes, _ = learn(labelled, train_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _predict(names, prototypes, "text"), "doc_id long, _lang_pred string, _lang_score double, _lang_letters long")
    return rows.drop("_lang_letters").withColumnsRenamed({"_lang_pred": "lang_pred", "_lang_score": "score"})


def accepted(docs: DataFrame, labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of `docs` (doc_id, text) that are told to be in a learned language; columns unchanged, whatever their names.

    A text of SHORT_LETTERS letters or more needs a score above that of random letters of the language it is told to be
    (`chance`), a shorter one MIN_SCORE: so texts in other scripts and letter noise go. Null texts and those without
    letters are rejected, as are all if no language is learned. Repeated rows stay or go together; null ids and empty
    tables are no special case.
    """
    names, prototypes, letters = learn(labelled, train_docs)
    level = {n: chance(p, usual) for n, p, usual in zip(names, prototypes, letters, strict=True)}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), "text")
    schema = T.StructType([rows.schema["r"], T.StructField("_lang_pred", T.StringType()), T.StructField("_lang_score", T.DoubleType()),
                           T.StructField("_lang_letters", T.LongType())])
    told = rows.mapInArrow(_predict(names, prototypes, "text"), schema)
    needed = F.lit(2.0)
    for name, x in level.items():
        needed = F.when(F.col("_lang_pred") == name, F.lit(x)).otherwise(needed)
    needed = F.when(F.col("_lang_letters") < SHORT_LETTERS, F.lit(MIN_SCORE)).otherwise(needed)
    return told.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") > needed)).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, docs.filter(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
