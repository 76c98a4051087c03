"""Text normalization: accents, folding, title keys, mangled names, identifiers, URLs."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of an edition's notes inside brackets ...
EDITION_WORDS = "deluxe|remaster|expanded|anniversary|edition|version|bonus|reissue|mono|stereo|explicit|clean|special|collector"
#: ... and after a dash or colon up to the line's end, which has to be the title's (an ASCII word end follows the word,
#: since \b takes any Unicode letter for a word character here).
SUFFIX_WORDS = "deluxe|remastered|remaster|expanded|anniversary|special"
_WORD_END = "(?![A-Za-z0-9_])"
#: What regular expressions here take for white space.
_BLANK = " \t\n\x0b\f\r"
#: Fixed value: the form of natural ids.
ID_PATTERN = "^[0-9A-Za-z]{22}$"
#: The address below which cards link to pages; a parameter wherever it is used.
CARD_URL = "https://open.example.org"
#: An image's key is a path's last segment less its first 16 characters, of this form.
HASH_SKIP, HASH_PATTERN = 16, "^[0-9a-f]{24}$"
#: What stands before an image's key, by kind and size.
IMAGE_SIZES = {
    "album": {"xs": "ab67616d00004851", "sm": "ab67616d00001e02", "md": "ab67616d0000b273", "lg": "ab67616d000082c1"},
    "artist": {"sm": "ab6761610000f178", "md": "ab67616100005174", "lg": "ab6761610000e5eb"},
}
#: The address below which images lie; a parameter wherever it is used.
IMAGE_URL = "https://images.example.org/image"


@functools.cache
def _combining() -> str:
    """A pattern of all characters of a combining class other than 0."""
    ranges: list[list[int]] = []
    for c in filter(lambda c: unicodedata.combining(chr(c)), range(0x110000)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]+"


def bare_texts(texts: pa.Array) -> pa.Array:
    """Texts without marks, composed again. Without marks, only Korean syllables compose, so texts without such are done."""
    bare = pc.replace_substring_regex(pc.utf8_normalize(texts, form="NFD"), r"\p{M}+", "")
    korean = pc.fill_null(pc.match_substring_regex(bare, r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}]"), False)
    if not pc.any(korean).as_py():
        return bare
    composed = [unicodedata.normalize("NFC", s) for s in bare.filter(korean).to_pylist()]
    return pc.replace_with_mask(bare, korean, pa.array(composed, bare.type))


def folded_texts(texts: pa.Array) -> pa.Array:
    """Compatibility-decomposed texts without combining characters."""
    return pc.replace_substring_regex(pc.utf8_normalize(texts, form="NFKD"), _combining(), "")


@F.arrow_udf(T.StringType())
def _bare_udf(texts: pa.Array) -> pa.Array:
    return bare_texts(texts)


@F.arrow_udf(T.StringType())
def _folded_udf(texts: pa.Array) -> pa.Array:
    return folded_texts(texts)


def _changed(c: Column, udf) -> Column:
    """A change that leaves ASCII as it is: only texts with other characters go to Python, where Arrow changes a batch at once."""
    plain = c.rlike("^[\\x00-\\x7f]*$")
    return F.when(plain, c).otherwise(udf(F.when(~plain, c)))


def strip_accents(c: Column) -> Column:
    """Drop combining marks after canonical decomposition; null stays null."""
    return _changed(c, _bare_udf)


def fold(c: Column) -> Column:
    """Compatibility-decompose, drop combining characters, lower-case: the form in which searches compare."""
    return F.lower(_changed(c, _folded_udf))


def fold_text(s: str) -> str:
    """fold() of one string on the driver, for a query's terms."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def without_editions(c: Column) -> Column:
    """c without bracketed notes of an edition and the white space before them, in time linear in its length.

    A note runs from the first opening bracket after the closing one before it to the next closing one.
    """

    def cut(piece: Column) -> Column:
        note = piece.rlike(r"[)\]]\z") & piece.rlike(rf"(?s)\A[^(\[]*+[(\[].*?(?:{EDITION_WORDS})")
        return F.when(note, F.rtrim(F.regexp_extract(piece, r"\A[^(\[]*+", 0), F.lit(_BLANK))).otherwise(piece)

    return _once(c, lambda c: F.when(c.rlike(r"[)\]]"), F.array_join(F.transform(F.split(c, r"(?<=[)\]])"), cut), "")).otherwise(c))


def without_suffix(c: Column) -> Column:
    """c without the note of an edition that its last line has from a dash or colon on, in time linear in its length."""
    word = rf"(?:{SUFFIX_WORDS}){_WORD_END}"

    def cut(c: Column, last: Column) -> Column:
        before = F.rtrim(F.left(c, F.length(c) - F.length(last)), F.lit(_BLANK))
        # the dash may end an earlier line, the word begin the last one
        carried = last.rlike(rf"\A\s*+{word}") & before.rlike(r"[-–:]\z")
        own = F.length(c) - F.length(last) + F.length(F.regexp_extract(last, rf"\A(.*?)[-–:]\s*+{word}", 1))
        kept = F.when(carried, F.left(before, F.length(before) - 1)).otherwise(F.left(c, own))
        return F.when(carried | last.rlike(rf"[-–:]\s*+{word}"), F.rtrim(kept, F.lit(_BLANK))).otherwise(c)

    return _once(c, lambda c: _once(F.substring_index(c, "\n", -1), lambda last: cut(c, last)))


def title_norm(name: Column, ampersand: bool = True) -> Column:
    """Title without accents, edition notes and punctuation, in lower case. ampersand: & reads as "and"."""
    c = F.lower(strip_accents(name))
    if ampersand:
        c = F.replace(c, F.lit("&"), F.lit("and"))
    c = without_suffix(without_editions(c))
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N} ]", ""))


def question_marks(name: Column) -> Column:
    """Number of ? in a name."""
    return F.length(name) - F.length(F.replace(name, F.lit("?"), F.lit("")))


def dedup_key(name: Column, norm: Column, own_id: Column, owner: Column | None = None) -> Column:
    """Key under which variants of a title meet: the row's own id where the title is unreadable or nothing is left of it."""
    own = F.concat(F.lit("ID:"), own_id.cast("string"))
    return F.when((question_marks(name) >= 2) | (norm == ""), own).otherwise(norm if owner is None else F.concat(owner.cast("string"), F.lit("|"), norm))


def mangle(c: Column) -> Column:
    """What a name becomes in Latin-1 with ? for every other character."""
    return F.regexp_replace(c, r"[^\x00-\xFF]", "?")


def repaired(name: Column, official: Column) -> Column:
    """The official name if it is other than name and provably mangles to it; else name."""
    return F.when(official.isNotNull() & (official != name) & (mangle(official) == name), official).otherwise(name)


def valid_id(c: Column) -> Column:
    """Whether c has the form of a natural id."""
    return F.coalesce(c.rlike(ID_PATTERN), F.lit(False))


def image_key(url: Column) -> Column:
    """The key in an image URL's last segment; null where it has another form."""
    key = F.substring(F.substring_index(url, "/", -1), HASH_SKIP + 1, 1000)
    return F.when(key.rlike(HASH_PATTERN), key)


def haystack(*parts: Column) -> Column:
    """What searches look through: folded parts, two spaces between; null is empty."""
    return fold(F.concat_ws("  ", *(F.coalesce(p, F.lit("")) for p in parts)))


def grouped_digits(n: Column, mark: str = ".") -> Column:
    """A whole number as text with a mark between groups of three digits."""
    return F.regexp_replace(n.cast("bigint").cast("string"), r"(?<=[0-9])(?=([0-9]{3})+$)", mark)


def card_url(kind: str, own_id: Column, base: str = CARD_URL) -> Column:
    """The address of a card's page: base/kind/id; null without an id."""
    return F.concat(F.lit(f"{base}/{kind}/"), own_id)


def image_url(kind: str, key: Column, size: str, base: str = IMAGE_URL) -> Column:
    """The address of an image of a kind in a size; null without a key. Unknown kinds and sizes are errors."""
    if size not in IMAGE_SIZES.get(kind, {}):
        raise ValueError(f"no images of {kind} in size {size}")
    return F.concat(F.lit(f"{base}/{IMAGE_SIZES[kind][size]}"), F.when(key != "", key))


def id_list(text: str, limit: int = 60) -> list[str]:
    """Ids of a comma-separated list, stripped, valid ones only, each once in order, at most limit."""
    import re

    found = dict.fromkeys(x.strip() for x in text.split(","))
    return [x for x in found if re.match(ID_PATTERN, x)][:limit]
