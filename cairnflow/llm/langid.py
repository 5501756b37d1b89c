"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with the words that texts of
that language share, taken from a bounded sample of labelled rows.  A text, its words in
lower case, is cut into windows of one size, the last one filled up from the text's start;
each window is compressed with every dictionary, and the language with the smallest sum is
chosen.  A window's margin is what the chosen language saves against the best other one in
that window, as a share of it; the mean over the windows is the text's margin, the score's
base, and a text whose margin is narrower than ``least_margin`` is rejected.  As every window
meets the bare dictionary, the margin of a text in one language is the same whatever its
length; in a text of two languages the windows speak against each other.

The dictionaries are the only state: at most ``most_langs`` times ``dict_bytes``, so they
are sent to the executors whatever the size of the corpus.  Prediction is one pass, without
a shuffle, over whole texts, in linear time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, strings

UNDETERMINED = "und"
#: Characters of a window.
WINDOW = 512
#: Letters and spaces below which a text stays whatever its margin: a few bytes tell little, and two languages hardly fit in.
SHORT = 24


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dict_bytes: int = 96 << 10, slots: int = 512, row_chars: int = 1000, most_langs: int = 64) -> dict[str, bytes]:
    """Dictionaries by language from a bounded sample: text hashes are dealt to ``slots``
    slots, and for each language the text with the smallest hash of each slot counts, with
    ``row_chars`` characters of each from a place that its hash chooses, up to ``dict_bytes``
    in all.  Null labels or texts are left out; more than ``most_langs`` languages raise
    ValueError; without labelled rows there are none.  The dictionaries are in the order of
    the languages' counts of rows, the most frequent first.
    """
    hashed = labelled.select(labelled[lang_col].cast("string").alias("lang"), labelled[text_col].alias("text")).where("lang is not null and length(text) > 0").withColumn("h", F.xxhash64("text"))
    first = F.pmod(F.col("h"), F.greatest(F.length("text") - row_chars + 1, F.lit(1))).cast("int") + 1
    sample = hashed.select("lang", "h", F.substring("text", first, F.lit(row_chars)).alias("text"))
    counts = sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs + 1)
    langs = [r["lang"] for r in counts.collect()]
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    # at most slots rows of a language, also in every partial aggregate
    least = sample.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    texts = sample.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    held: dict[str, list[str]] = {lang: [] for lang in langs}
    for r in texts.collect():
        held[r["lang"]].append(r["text"])
    return {lang: dictionary(found, dict_bytes) for lang, found in held.items()}


def dictionary(texts: list[str], most_bytes: int) -> bytes:
    """Words that several of the texts hold, the most common last, where a match costs the fewest bits.

    Words of one text alone are left out, so a text under a wrong label adds nothing; if no
    word is common, all count.
    """
    seen = Counter(w for t in texts for w in set(letters(t).split()))
    common = [w for w, n in seen.items() if n > 1] or list(seen)
    return (" ".join(sorted(common, key=lambda w: (seen[w], w))) + " ").encode("utf-8", "replace")[-most_bytes:]


class Classifier:
    """Compresses with each dictionary; made once in each worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6):
        import zstandard as zstd

        self.langs = list(dictionaries)
        how = zstd.ZstdCompressionParameters.from_level(level, write_content_size=0, write_dict_id=0)
        self.tools = []
        for content in dictionaries.values():
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.tools.append(zstd.ZstdCompressor(dict_data=d, compression_params=how))
        self.frame = len(zstd.ZstdCompressor(level=level, write_content_size=False).compress(b""))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed sizes, less the frame, of each window (row) by language (column)."""
        found = [w.encode("utf-8", "replace") for w in windows(text)]
        return np.array([[len(t.compress(w)) for w in found] for t in self.tools]).T - self.frame

    def predict(self, text: str, least_margin: float) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected); undetermined for a text without a letter."""
        text = letters(text)
        if not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        sizes = self.sizes(text)
        best = int(sizes.sum(axis=0).argmin())
        others = np.delete(sizes, best, axis=1).min(axis=1) if len(self.langs) > 1 else 2 * sizes[:, best]
        margin = float(((others - sizes[:, best]) / others).mean())
        return self.langs[best], min(1.0, max(0.0, 0.5 + 2 * margin)), margin, margin < least_margin

    def keeps(self, text: str, least_margin: float) -> bool:
        """Whether a text stays: it isn't rejected, or has letters, but too few to tell."""
        _, _, _, rejected = self.predict(text, least_margin)
        return not rejected or 0 < len(letters(text)) < SHORT and any(map(str.isalpha, text))


def windows(text: str, size: int = WINDOW) -> list[str]:
    """The text in windows of ``size`` characters; it goes on from its start until the last one is full."""
    count = -(-len(text) // size)
    again = text + " "
    filled = text + " " + again * (size // len(again) + 1)
    return [filled[k * size : (k + 1) * size] for k in range(count)]


#: Runs of anything but letters.
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text's words in lower case, a space between them; empty if it has no letter.

    Case, digits, punctuation and markup say little about the language.
    """
    return OTHER.sub(" ", text.lower()).strip()


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", least_margin: float = 0.03, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, lang_pred, score (0 to 1), margin and rejected.

    lang_pred is the language of the smallest compressed size, ``und`` for a null text or
    one without a letter; ties go to the language with more labelled rows, with margin 0.
    rejected is true for ``und``, and for texts with margins below ``least_margin``, in a very
    short text ties.  A very long text is read whole, window by window, and its length doesn't
    change its margin.  Ids may be null or repeated; of other columns only ``keep`` are carried
    along; an empty table gives an empty result; without dictionaries every text is ``und``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, margin, rejected = zip(*(classifier.predict(t, least_margin) for t in strings(b.column(1))))
            added = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())]
            return pa.RecordBatch.from_arrays([b.column(0), *added, *b.columns[2:]], ["id", "lang_pred", "score", "margin", "rejected", *(f"k{i}" for i in range(len(keep)))])

        yield from map_slices(batches, "text", work)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[c].alias(f"k{i}") for i, c in enumerate(keep)))
    kept = "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, margin double, rejected boolean{kept}")
    return out.withColumnsRenamed({"id": id_col} | {f"k{i}": c for i, c in enumerate(keep)})


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", least_margin: float = 0.03) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text :func:`predict` doesn't reject, and those of less than SHORT letters.

    Sizes of a few words tie more often than not, which is nothing against them.
    Without dictionaries there is nothing to tell languages by, and all texts with letters stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(b.column(text_col))
            kept = [classifier.keeps(t, least_margin) for t in texts] if dictionaries else [any(map(str.isalpha, t)) for t in texts]
            return b.filter(pa.array(kept, pa.bool_()))

        yield from map_slices(batches, text_col, work)

    return docs.mapInArrow(run, docs.schema)
