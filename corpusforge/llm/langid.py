"""Language id by multilingual mixture inference.

Training counts character trigrams (letters lower-cased, all else one space) per language into BUCKETS hashed cells
over every training document. A document is then a mixture of languages: expectation-maximisation on its trigram
counts estimates the proportions, and the set of languages is chosen by penalised likelihood, a language costing
PENALTY * ln(trigrams). The single best language is kept at once where concavity proves that no mixture can gain
more than its cost; else languages are dropped one by one, the least first, as long as that pays.

The model has BUCKETS cells per language: its size is bounded by the number of languages (MAX_LANGUAGES).

Nulls and the rest: null text, or text without a letter, gives `und` and score 0; so does every text if nothing
can be learned (empty table, no labels). Documents with null lang teach nothing. Ties go to the language that
sorts first. Repeated rows each get a row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_rows, lean, unused

BUCKETS = 1 << 15
SMOOTH = 0.2
PENALTY = 4.0
ROUNDS = 10
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
_BLOCK = 1 << 20
#: Cells of all languages that a worker infers over at a time.
_CELLS = 1 << 21


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells and counts of the whole text; None if it has no letter."""
    if not text:
        return None
    total = np.zeros(BUCKETS, np.int64) if len(text) > _BLOCK else None
    found, last = False, np.array([32, 32], np.uint32)
    for at in range(0, len(text), _BLOCK):
        c = np.frombuffer(text[at : at + _BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        found = found or bool(letter.any())
        c = np.where(letter, c, np.uint32(32))
        c = np.concatenate((last[-2:], c, np.array([32], np.uint32) if at + _BLOCK >= len(text) else np.empty(0, np.uint32)))
        space = c == 32
        keep = ~(space & np.concatenate(([False], space[:-1])))
        c = c[keep]
        if len(c) >= 3:
            h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
            cells = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
            n = np.bincount(cells, minlength=BUCKETS)
            if total is None:
                total = n
            else:
                total += n
        last = np.concatenate((last, c))[-2:]
    if not found or total is None:
        return None
    at = np.flatnonzero(total)
    return (at, total[at]) if len(at) else None


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities (cells x languages), from text and lang of all docs."""
    arrow_rows(docs.sparkSession)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if got := trigrams(text):
                    if lang not in held:
                        held[lang] = np.zeros(BUCKETS, np.int64)
                    held[lang][got[0]] += got[1]
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "cell", "n"])

    few = docs.where("lang IS NOT NULL").select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if few > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} values of lang; the model is bounded to them")
    rows = docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(lean(count), "lang string, cell int, n long")
    model = rows.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(model.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    of = {x: i for i, x in enumerate(names)}
    counts[model.column("cell").to_numpy(), [of[x] for x in model.column("lang").to_pylist()]] = model.column("n").to_numpy()
    return names, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, lens: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood (up to a constant of the document) of each document, over its allowed languages.

    p: likelihoods of each cell, scaled by cell; n: counts; starts, lens: the cells of each document.
    """
    share = mask / mask.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(ROUNDS):
        w = p * np.repeat(share, lens, axis=0).astype(np.float32)
        w *= (n / w.sum(axis=1))[:, None]
        share = np.add.reduceat(w, starts, axis=0) / total
    s = np.einsum("ij,ij->i", p, np.repeat(share, lens, axis=0).astype(np.float32))
    return share, np.add.reduceat(n * np.log(s), starts)


def infer(grams: list[tuple[np.ndarray, np.ndarray]], log_p: np.ndarray) -> np.ndarray:
    """Language proportions of each document (documents x languages)."""
    k = log_p.shape[1]
    lens = np.array([len(g[0]) for g in grams])
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    n = np.concatenate([g[1] for g in grams]).astype(np.float32)
    lp = log_p[np.concatenate([g[0] for g in grams])]
    total = np.add.reduceat(n, starts)
    cost = PENALTY * np.log1p(total)
    alone = np.add.reduceat(lp * n[:, None], starts, axis=0)
    best = alone.argmax(axis=1)
    out = np.zeros((len(grams), k))
    out[np.arange(len(grams)), best] = 1
    if k == 1:
        return out
    top = lp.max(axis=1)
    p = np.exp(lp - top[:, None])
    # By concavity no mixture gains more over the best language than the steepest slope there.
    own = p[np.arange(len(p)), np.repeat(best, lens)]
    slope = np.add.reduceat(p * (n / own)[:, None], starts, axis=0).max(axis=1) - total
    left = np.flatnonzero(slope > cost)
    scale = np.add.reduceat(n * top, starts)
    mask = np.ones((len(grams), k), bool)
    score = np.full(len(grams), -np.inf)
    share = np.zeros((len(grams), k))
    single = alone.max(axis=1) - cost
    while len(left):
        rows = np.concatenate([np.arange(starts[i], starts[i] + lens[i]) for i in left])
        at = np.concatenate(([0], np.cumsum(lens[left])[:-1]))
        got, ll = _em(p[rows], n[rows], at, lens[left], mask[left])
        ll = ll + scale[left]
        now = ll - cost[left] * mask[left].sum(axis=1)
        # A set that can't beat one language even at the cost of two is done with; so is one that lost by a drop.
        better = (now >= score[left]) & (ll - 2 * cost[left] > single[left])
        share[left[better]], score[left[better]] = got[better], now[better]
        left, got = left[better], got[better]
        weakest = np.where(mask[left], got, np.inf).argmin(axis=1)
        mask[left, weakest] = False
        left = left[mask[left].sum(axis=1) > 1]
    mixed = score > single
    out[mixed] = share[mixed]
    return out


def _parts(grams: list, some: list[int], languages: int):
    """Runs of the numbers `some` whose documents have _CELLS cells of all languages together, or one document."""
    part, size = [], 0
    for i in some:
        n = len(grams[i][0]) * languages
        if part and size + n > _CELLS:
            yield part
            part, size = [], 0
        part.append(i)
        size += n
    if part:
        yield part


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs with `pred` (the language of the largest proportion) and `score` (that proportion).

    Columns of docs that are called so are replaced.
    """
    out = pred, score
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    docs = docs.select(*names)

    def each(batches):
        langs, log_p = shared.value
        for b in batches:
            grams = [trigrams(t) if langs else None for t in b.column("text").to_pylist()]
            some = [i for i, g in enumerate(grams) if g]
            pred, score = [UNDETERMINED] * len(grams), [0.0] * len(grams)
            for part in _parts(grams, some, len(langs)):
                for i, row in zip(part, infer([grams[i] for i in part], log_p)):
                    best = int(row.argmax())
                    pred[i], score[i] = langs[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(each), f"{schema}, `{out[0]}` string, `{out[1]}` double")


def held_out(doc_id, parts: int, part: int):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that are mostly in one language: those without a letter, or with no language at `least`, go."""
    model = train(docs)
    pred, score = unused(docs.columns, "lang_pred", "score")
    known = identify(docs, model, pred, score)
    return known.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)
