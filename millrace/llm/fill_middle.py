"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, which are put in another order between marks.

One Arrow-batched pandas UDF does all of a document: ``finditer`` of the regex library walks over the units (code points by
default; words, lines or grapheme clusters by another pattern), a run of units to a match since the library keeps every capture
of a repeated group, and their end offsets go into a compact array of four bytes a unit; two lookups in it give the places of
the cuts.  The digest of seed and id chooses places and form, so a
document is cut the same way in every run, whatever the partitioning.  ``restored`` is the inverse.

Scale: row-local, no shuffle; a task holds one Arrow batch (``common.BATCH_ROWS`` rows at most) and one array of offsets.

Nulls: a null text counts as empty (form plain, no unit), a null id as the empty string.  Texts that no unit matches in part:
what follows the last unit belongs to the suffix, what lies between units to the unit after it.  Rows of equal id and text
give equal rows; other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.llm.common import text_or_empty

PLAIN, PSM, SPM = "plain", "psm", "spm"
CODE_POINTS, WORDS, LINES, GRAPHEMES = r"(?s:.)", r"\s*\S+", r"[^\n]*\n|[^\n]+", r"\X"
#: Units to a match.
RUN = 256

CUT = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()),
                  StructField("middle_chars", LongType()), StructField("output", StringType()), StructField("output_sha256", StringType())])
BACK = StructType([StructField("text", StringType()), StructField("restored_sha256", StringType())])


@dataclass(frozen=True)
class Marks:
    """The three marks; a text that contains one stays as it is."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        every = (self.prefix, self.suffix, self.middle)
        if len(set(every)) < 3 or not all(every):
            raise ValueError("three different marks are needed")
        for a in every:
            for b in every:
                inside = a != b and a in b
                if inside or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b)) if b[:k] != a):
                    raise ValueError(f"marks {a!r} and {b!r} overlap: outputs could not be taken apart")

    def found_in(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text


def draws(seed: str, doc_id: int | str | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first groups of eight hex digits of sha256(``seed:doc_id``)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def units(pattern: str) -> regex.Pattern:
    """A run of units, each of which keeps what it matched: the same units as a search for one after the other."""
    if regex.match(pattern, "") or regex.match(pattern, "a") and not regex.match(pattern, "a").group():
        raise ValueError("a unit cannot be empty")
    return regex.compile(f"((?>{pattern})){{1,{RUN}}}+")


def unit_ends(text: str, run: regex.Pattern) -> array:
    """End offsets of the units, left to right."""
    ends = array("I")
    for m in run.finditer(text):
        ends.extend(m.ends(1))
    return ends


def joined(prefix: str, middle: str, suffix: str, form: str, marks: Marks) -> str:
    if form == PSM:
        return f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"
    return f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"


def taken_apart(output: str, form: str, marks: Marks = Marks()) -> str:
    """The text that ``output`` was made of."""
    if form == PLAIN:
        return output
    first, second = (marks.prefix, marks.suffix) if form == PSM else (marks.suffix, marks.prefix)
    a, b = output.index(second, len(first)), output.index(marks.middle)
    one, two, middle = output[len(first):a], output[a + len(second):b], output[b + len(marks.middle):]
    return one + middle + two if form == PSM else two + middle + one


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class FillMiddle:
    """What is asked for: unit, seed, shares in percent of texts cut at all and of suffix-first ones among them, marks."""

    unit: str = CODE_POINTS
    seed: str = "1"
    cut_percent: int = 90
    spm_percent: int = 20
    marks: Marks = Marks()

    def of(self, doc_id, text: str, run: regex.Pattern) -> tuple:
        """n, form, prefix_chars, middle_chars, output, its digest."""
        ends = unit_ends(text, run)
        n = len(ends)
        h1, h2, h3, h4 = draws(self.seed, doc_id)
        if not text or h3 % 100 >= self.cut_percent or self.marks.found_in(text):
            return n, PLAIN, None, None, text, _sha256(text)
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (first, second))
        form = SPM if h4 % 100 < self.spm_percent else PSM
        output = joined(text[:a], text[a:b], text[b:], form, self.marks)
        return n, form, a, b - a, output, _sha256(output)


def fill_middle(doc_id: Column, text: Column, how: FillMiddle = FillMiddle()) -> Column:
    """Struct of n, form, prefix_chars, middle_chars (code points; null if plain), output, output_sha256."""
    @F.pandas_udf(CUT)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        run = units(how.unit)
        out = pd.DataFrame([how.of(i, t, run) for i, t in zip(ids, texts)], columns=CUT.fieldNames())
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut(doc_id.cast("string"), text)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """Struct of text and restored_sha256: the text that an output was made of, from the output and its form alone."""
    @F.pandas_udf(BACK)
    def back(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [taken_apart(o, f, marks) for o, f in zip(outputs, forms)]
        return pd.DataFrame({"text": texts, "restored_sha256": [_sha256(t) for t in texts]}, dtype=object)

    return back(output, form)


def transform(docs: DataFrame, how: FillMiddle = FillMiddle(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256 of every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.select("doc_id", fill_middle(F.col("doc_id"), F.col("text"), how).alias("cut")).select("doc_id", "cut.*")


def brute_force(doc_id, text: str | None, how: FillMiddle = FillMiddle()) -> dict:
    """By the definition, for code points: slices of the text itself (for tests)."""
    text = text or ""
    hexed = hashlib.sha256((how.seed + ":" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(hexed[8 * k:8 * k + 8], 16) for k in range(4)]
    m = how.marks
    if text == "" or any(x in text for x in (m.prefix, m.suffix, m.middle)) or h[2] % 100 >= how.cut_percent:
        return {"n": len(text), "form": PLAIN, "prefix_chars": None, "middle_chars": None, "output": text}
    a, b = min(h[0] % (len(text) + 1), h[1] % (len(text) + 1)), max(h[0] % (len(text) + 1), h[1] % (len(text) + 1))
    p, mid, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < how.spm_percent:
        return {"n": len(text), "form": SPM, "prefix_chars": a, "middle_chars": b - a, "output": m.suffix + s + m.prefix + p + m.middle + mid}
    return {"n": len(text), "form": PSM, "prefix_chars": a, "middle_chars": b - a, "output": m.prefix + p + m.suffix + s + m.middle + mid}
