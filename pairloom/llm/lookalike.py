"""Visually identical text with different characters: one printed form for all of them.

The form is made by DuckDB inside Arrow partitions: nfc_normalize (combining accents, compatibility ideographs), translate (full
width, blanks, look-alike letters, half-width kana) and regular expressions (invisible characters). What can be seen stays:
letter case, accents, raised digits, the number of blanks, line breaks.

A null text has no form; an empty text has an empty one. Texts are taken whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_by_load

#: Letters of other alphabets and the Latin letters that they look like (fixed values).
LOOKALIKES = {
    "Cyrillic": ("АВЕІЈКМНОРСЅТУХҮԌԚԜаеіјорсѕухԁһԛԝѵ", "ABEIJKMHOPCSTYXYGQWaeijopcsyxdhqwv"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ", "ABEZHIKMNOPTYXoj"),
    "Armenian": ("օՕոսհՍ", "oOnuhU"),
    "Cherokee": ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏚᏙᏟᏢᏦᏴᏞ", "DRTiAJEWMHYGZSVCPKBL"),
}
#: Letters printed as one glyph and their parts (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǈ": "Lj", "Ǉ": "LJ", "ǌ": "nj", "ǋ": "Nj", "Ǌ": "NJ"}
#: Characters that leave no mark in print: soft hyphen, joiners, direction marks, word joiner, byte order mark.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]"
#: A joiner between two pictures makes one picture of them, which can be seen.
PICTURES = r"([\p{So}\x{1F3FB}-\x{1F3FF}\x{FE0F}])\x{200D}(\p{So})"


def _letters() -> dict[str, str]:
    return {x: y for a, b in LOOKALIKES.values() for x, y in zip(a, b, strict=True)}


def _tables() -> dict[str, str]:
    """Single characters and what stands for them, by rule where there is one."""
    pairs = {}
    for c in map(chr, [*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7), *range(0xFF61, 0xFFDD)]):  # full and half width
        to = unicodedata.normalize("NFKC", c)
        if len(to) == 1 and to != c:
            pairs[c] = to
    pairs |= {"ﾞ": "゙", "ﾟ": "゚", "￣": "¯"}
    pairs |= {c: " " for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs" and c != "\u1680"}  # blanks of any width; U+1680 is a stroke
    return pairs | {"‐": "-", "‑": "-"} | _letters()


def _accented() -> dict[str, str]:
    """Letters of other alphabets with accents whose bare letter looks like a Latin one: the Latin letter with the accents."""
    bare, out = _letters(), {}
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in bare:
            out[c] = unicodedata.normalize("NFC", bare[base] + "".join(marks))
    return out


def form_sql(column: str = "text") -> str:
    """The DuckDB expression of the printed form.

    Letters are mapped before accents are joined to them, and those that stood joined from the start after it, so that texts that
    are canonically equivalent have one form.
    """
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    translated = lambda x, t: f"translate({x}, {quoted(''.join(t))}, {quoted(''.join(t.values()))})"
    x = column
    for _ in range(2):  # a chain of pictures overlaps
        x = rf"regexp_replace({x}, '{PICTURES}', '\1' || chr(64976) || '\2', 'g')"
    x = translated(f"regexp_replace({x}, '{INVISIBLE}', '', 'g')", _tables())
    for k, v in LIGATURES.items():
        x = f"replace({x}, {quoted(k)}, {quoted(v)})"
    accented = _accented()
    x = translated(f"nfc_normalize({x})", {k: v for k, v in accented.items() if len(v) == 1})
    for k, v in accented.items():
        if len(v) > 1:
            x = f"replace({x}, {quoted(k)}, {quoted(v)})"
    return f"translate(nfc_normalize({x}), chr(64976), chr(8205))"


def printed_forms(df: DataFrame, ident: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """(id, form, letters): the printed form of each text and whether it holds a letter.

    With ``hashed``, (id, form, raw, letters): the MD5 of the form and of the text.
    """
    sql = f"SELECT id, text, {form_sql('text')} AS form FROM chunk"
    told = "md5(form) AS form, md5(text) AS raw" if hashed else "form"
    sql = rf"SELECT id, {told}, coalesce(regexp_matches(form, '\p{{L}}'), false) AS letters FROM ({sql})"
    fields = [("form", pa.string()), *([("raw", pa.string())] if hashed else []), ("letters", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for batch in batches:
            con.register("chunk", pa.Table.from_batches([batch]))
            done = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("chunk")
            yield from done.cast(pa.schema([("id", batch.schema.field("id").type), *fields])).to_batches()

    kind = df.schema[ident].dataType.simpleString()
    return df.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, form string, {'raw string, ' if hashed else ''}letters boolean")


def same_in_print(df: DataFrame, work, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), smaller id first: texts with a letter that have one form but aren't equal.

    Forms and texts are compared through 128-bit hashes. Copies of a text are one variant until the end: variants of a form are
    paired, then each variant's documents are put in, so no two equal texts are ever paired. A row without id names no case.
    """
    forms = printed_forms(df.filter(F.col(ident).isNotNull() & F.col(text).isNotNull()), ident, text, hashed=True)
    rows = work.save(forms.filter("letters").select("id", "form", "raw").distinct(), "forms")
    many = rows.groupBy("form").agg(F.min("raw").alias("x"), F.max("raw").alias("y"), F.count(F.lit(1)).alias("load")).filter("x <> y").select("form", "load")
    v = work.save(join_by_load(rows, many, ["form"], "load", rows.count()).select("form", "raw").distinct(), "variants")
    ab = v.select("form", F.col("raw").alias("raw_a")).join(v.select("form", F.col("raw").alias("raw_b")), "form").filter("raw_a < raw_b")
    a = rows.select(F.col("raw").alias("raw_a"), F.col("id").alias("ia"))
    b = rows.select(F.col("raw").alias("raw_b"), F.col("id").alias("ib"))
    pairs = ab.drop("form").join(a, "raw_a").join(b, "raw_b")
    return pairs.select(F.least("ia", "ib").alias("doc_id_a"), F.greatest("ia", "ib").alias("doc_id_b")).distinct()
