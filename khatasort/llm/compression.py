"""Quality by compression: two zstandard dictionaries, one built from good and one from bad labelled texts.

A text is compressed whole with the good dictionary (g bytes) and with the bad one (b).  The difference, normalised by
the text's length, (b - g) / (bytes + ``FLOOR``), is how many bytes the good dictionary saves for each byte of text: good texts save some everywhere,
texts that repeat themselves or are made of other things save none.  A logistic curve over that one figure, fitted on labelled texts, is the score.

Labels come from the rows outside the held-out fold, at most ``most`` of them (the ids with the smallest md5): one half,
in a fixed draw, builds the dictionaries, the other calibrates, so no text is calibrated by a dictionary that knows it.
Both dictionaries are built alike at every size: whole texts in the order of the draw, as many as fit into the same number of bytes, which is
what the class with less text has, at most ``DICTIONARY_BYTES``.  Every document is scored whole; a long one goes through the
compressor in pieces of ``PIECE`` bytes, all counted, so the dictionary is in reach from its first byte to its last.

Defined cases: null and empty texts compress alike and get the curve's score of no difference; without labels of
both kinds all scores are the share of good labels (0.5 without labels); repeated rows score alike; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, fold, labelled_sample, logistic, table

NAME = "op3_compression_quality"
ORACLE_SQL = None

FOLDS, HELD = 3, 1
MOST = 4000
DICTIONARY_BYTES, PIECE, LEVEL = 768 << 10, 64 << 10, 9
#: Bytes added to a text's length, so that a few words alone aren't far from no difference.
FLOOR = 50


def dictionaries(sample: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """The good and the bad dictionary, of the same size at most, from (text, quality) pairs."""
    own = [[x for x, y in sample if y == k and x] for k in (1, 0)]
    room = min(DICTIONARY_BYTES, *(sum(len(x) + 1 for x in texts) for texts in own))
    found = []
    for texts in own:
        held, size = [], 0
        for x in texts:
            if size + len(x) + 1 <= room:
                held.append(x)
                size += len(x) + 1
        found.append(b"\n".join(held))
    return found[0], found[1]


class Model:
    """Dictionaries and curve (slope and intercept); flat is the score where there is nothing to compare."""

    def __init__(self, good: bytes, bad: bytes, curve: tuple[float, float] | None = None, flat: float = 0.5):
        self.parts = (good, bad, curve, flat)
        self._tools = None

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.parts, self._tools = parts, None

    def _compressors(self):
        if self._tools is None:
            self._tools = []
            for raw in self.parts[:2]:
                extra = {}
                if raw:
                    extra["dict_data"] = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    extra["dict_data"].precompute_compress(level=LEVEL)
                self._tools.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **extra))
        return self._tools

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """The normalised difference of each text's compressed sizes."""
        good, bad = self._compressors()
        found = np.zeros(len(texts))
        for i, x in enumerate(texts):
            pieces = [x[k : k + PIECE] for k in range(0, len(x), PIECE)]
            found[i] = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces) / (len(x) + FLOOR)
        return found

    def score(self, texts: list[bytes]) -> np.ndarray:
        _, _, curve, flat = self.parts
        if curve is None:
            return np.full(len(texts), flat)
        return 1 / (1 + np.exp(-np.clip(curve[0] * self.differences(texts) + curve[1], -30, 30)))


def fit(sample: list[tuple[bytes, int]]) -> Model:
    """From (text, quality) pairs in a fixed random order."""
    build, tune = sample[0::2], sample[1::2]
    labels = np.array([y for _, y in tune])
    if len({y for _, y in build}) < 2 or len(set(labels.tolist())) < 2:
        return Model(b"", b"", flat=float(np.mean([y for _, y in sample])) if sample else 0.5)
    good, bad = dictionaries(build)
    x = Model(good, bad).differences([x for x, _ in tune])
    mean, scale = x.mean(), x.std() + 1e-9
    slope, level = logistic(((x - mean) / scale)[:, None], labels, ridge=1e-4).tolist()
    return Model(good, bad, (slope / scale, level - slope * mean / scale))


def model_of(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    return fit([(x, int(y > 0)) for x, y, _ in labelled_sample(docs, labels, "quality", FOLDS, HELD, most)])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = sent.value.score(blobs(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, model_of(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted")
