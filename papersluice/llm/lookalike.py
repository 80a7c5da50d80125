"""One form for texts that look the same.

The form is a confusables skeleton: the text is decomposed, every character is replaced by its
prototype from the look-alike table, and the result is decomposed again. Two texts look the same
if and only if their skeletons are equal.

What makes no difference: width, the composition of accents, invisible characters, the kind of a
space, typographic styles of a letter, and a character of another script or block with the same
shape. What does: letter case, a missing accent, another, raised or circled digit, punctuation
and the number of spaces.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersluice.operators.skew import attach, pairs_within
from papersluice.session import materialize, spread

#: Prototype -> characters of other scripts and blocks with its shape.
LOOKALIKES = {
    # Latin letters: Cyrillic, Greek, Coptic, Armenian, Cherokee, Lisu, phonetic
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤ", "D": "ᎠꓓⅮ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ",
    "I": "ІΙӀꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ", "L": "Ꮮꓡ", "M": "МΜᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ",
    "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫⲬ", "Y": "УΥҮꓬⲨ", "Z": "ΖᏃꓜⲌ",
    "a": "аαɑ", "c": "сϲᴄꮯⲥ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏⲟ", "p": "рρⲣ",
    "q": "ԛզ", "s": "ѕꜱꮪ", "u": "υսᴜ", "v": "ѵνᴠꮩ", "w": "ԝѡաᴡꮃ", "x": "хⲭ", "y": "уү", "z": "ᴢꮓ", "ə": "ә", "æ": "ӕ",
    # Small capitals: Cherokee and phonetic
    "ᴀ": "ꭺ", "ᴇ": "ꭼ", "ᴊ": "ꭻ", "ʟ": "ꮮ", "ᴘ": "ꮲ", "ʀ": "ꮢ", "ɢ": "ꮐ",
    # Cyrillic letters in the shape of small capitals
    "в": "ʙ", "к": "ᴋĸꮶ", "м": "ᴍꮇ", "н": "ʜꮋ", "т": "ᴛꭲ", "п": "ᴨ", "л": "ᴫ", "я": "ᴙ",
    # Hyphens and colons of other blocks
    "-": "‐", ":": "∶",
    # Ideographs: kana and radicals
    "口": "ロ", "工": "エ", "力": "カ", "夕": "タ", "卜": "ト", "二": "ニ", "八": "ハ", "一": "ー", "へ": "ヘ",
    "足": "⻊", "肉": "⺼", "辶": "⻌⻍⻎", "厂": "⺁", "亻": "⺅", "刂": "⺉", "忄": "⺖", "扌": "⺘", "攵": "⺙", "氵": "⺡", "灬": "⺣", "犭": "⺨", "礻": "⺭", "纟": "⺰", "罒": "⺲", "艹": "⺾", "衤": "⻂", "讠": "⻈", "贝": "⻉", "钅": "⻐", "阝": "⻖", "饣": "⻠",
    "民": "⺠", "西": "⻄", "见": "⻅", "角": "⻆", "车": "⻋", "长": "⻓", "门": "⻔", "青": "⻘", "韦": "⻙", "页": "⻚", "风": "⻛", "飞": "⻜",
    "食": "⻝", "马": "⻢", "骨": "⻣", "鬼": "⻤", "鱼": "⻥", "鸟": "⻦", "麦": "⻨", "黄": "⻩", "齐": "⻬", "齿": "⻮", "龙": "⻰", "龟": "⻳",
}

#: Decomposition kinds of the character database that only change width or style.
SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: Format characters that are drawn.
DRAWN_FORMAT = range(0x600, 0x70F)


def _prototype(ch: str) -> str | None:
    """What the rules replace ``ch`` by: None for nothing to replace, an empty string for an invisible character."""
    kind, cp = unicodedata.category(ch), ord(ch)
    if kind == "Cf" and cp not in DRAWN_FORMAT or cp == 0x34F or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp <= 0xE0FFF or cp in (0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        return ""
    if kind == "Zs" or ch == "\t":
        return " "
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not tag.startswith("<"):
        return None
    target = "".join(chr(int(x, 16)) for x in rest.split())
    letters = kind[0] == "L" and kind != "Lm" and all(unicodedata.category(x)[0] == "L" for x in target) or kind == "Nl" and target.isalpha()
    radical = 0x2E80 <= cp <= 0x2FDF
    return target if tag in SAME_SHAPE or tag == "<compat>" and (letters or radical) else None


@lru_cache(maxsize=1)
def table() -> dict[int, str]:
    """Code point -> prototype, for decomposed text."""
    out = {ord(x): to for to, xs in LOOKALIKES.items() for x in xs}
    for cp in (*range(0x09, 0xD800), *range(0xF900, 0x20000), *range(0xE0000, 0xE1000)):
        to = _prototype(chr(cp))
        if to is not None and cp not in out and chr(cp) != to:
            out[cp] = to
    for cp, to in out.items():  # prototypes of prototypes
        for _ in range(4):
            again = unicodedata.normalize("NFD", to).translate(out)
            if again == to:
                break
            to = again
        out[cp] = to
    return out


def skeleton(text: str) -> str:
    """The form in which texts that look the same are equal."""
    if text.isascii():
        return text.replace("\t", " ")
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table()))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def shapes(records: DataFrame) -> DataFrame:
    """``field``, ``rec_id``, ``shape`` (digest of the skeleton) and ``own`` (digest of the text), one row each.

    128-bit digests stand for the texts in every shuffle, so a row costs the same however long its text is.
    """
    kind = records.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([_digest(skeleton(t)) for t in texts], pa.binary()), pa.array([_digest(t) for t in texts], pa.binary())],
                names=["field", "rec_id", "shape", "own"],
            )

    usable = records.select("field", "rec_id", "text").where("rec_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return spread(usable).mapInArrow(run, f"field string, rec_id {kind}, shape binary, own binary").distinct()


def forms(records: DataFrame) -> DataFrame:
    """``field``, ``rec_id``, ``form``: every record with its text in the one form; null texts stay null."""
    kind = records.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = pa.array([None if t is None else skeleton(t) for t in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), form], names=["field", "rec_id", "form"])

    return records.select("field", "rec_id", "text").mapInArrow(run, f"field string, rec_id {kind}, form string")


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """``field``, ``id_a``, ``id_b``: pairs with id_a < id_b of records of one field that look the same but are not the same string.

    Null and empty texts make no pairs, equal strings make none with each other, repeated rows count
    once; an empty table gives no rows. Different strings are paired, not records, and a group of many
    strings is split over many tasks.
    """
    rows = materialize(shapes(records), "shapes")
    strings = rows.select("field", "shape", "own").distinct()
    varied = strings.groupBy("field", "shape").agg(F.count("*").alias("n")).where("n > 1")
    a, b = pairs_within(strings, varied, ["field", "shape"], ["own"])
    a, b = a.withColumnRenamed("own", "own_a"), b.withColumnRenamed("own", "own_b")
    pairs = a.join(b, ["field", "shape", "_part"]).where("own_a < own_b").select("field", "own_a", "own_b")
    # Ids come last, so equal strings are never compared: a string of many records costs its links only.
    ids = rows.select("field", "rec_id", "own")
    linked = attach(ids.withColumnsRenamed({"rec_id": "x", "own": "own_a"}), pairs, ["field", "own_a"], ["x"])
    linked = attach(ids.withColumnsRenamed({"rec_id": "y", "own": "own_b"}), linked.select("field", "own_b", "x"), ["field", "own_b"], ["y"])
    return linked.where("x <> y").select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def lookalike_classes(records: DataFrame) -> DataFrame:
    """``field``, ``rec_id``, ``class_id``, ``n_strings``, ``n_links``: one row per record with the class of records that look like it.

    ``class_id`` is the least id of the class, ``n_strings`` counts the class's different strings, and
    ``n_links`` the records of the class whose string differs from the record's own: its pairs. A
    record that comes with several texts is in the class of each.
    """
    rows = materialize(shapes(records), "shapes")
    strings = rows.groupBy("field", "shape", "own").agg(F.min("rec_id").alias("least"), F.count("*").alias("same"))
    classes = strings.groupBy("field", "shape").agg(F.min("least").alias("class_id"), F.count("*").alias("n_strings"), F.sum("same").alias("n"))
    per_string = attach(strings, classes, ["field", "shape"], ["own"]).select("field", "shape", "own", "class_id", "n_strings", (F.col("n") - F.col("same")).alias("n_links"))
    return attach(rows, per_string, ["field", "shape", "own"], ["rec_id"]).select("field", "rec_id", "class_id", "n_strings", "n_links")
