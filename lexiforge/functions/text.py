"""Scalar text functions, as Columns. Word lists and patterns are parameters; language packs are in packs.py."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiforge.functions import packs

UNIT = "\u001f"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold_table() -> tuple[str, str]:
    """Letters with marks and what is left of them, for Latin and Cyrillic; combining marks go."""
    source, target = [], []
    for start, stop in ((0xC0, 0x250), (0x400, 0x460), (0x1E00, 0x1F00)):
        for code in range(start, stop):
            base, *marks = unicodedata.normalize("NFD", chr(code))
            if marks and all(unicodedata.combining(m) for m in marks):
                source.append(chr(code))
                target.append(base)
    return "".join(source) + "".join(map(chr, range(0x300, 0x370))), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def folded(text: str) -> str:
    """fold for a plain value."""
    return "".join(x for x in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(x))


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("string"), 256)


def stable_id(prefix: str, *parts: Column | str, length: int = 16) -> Column:
    """prefix, a dash and the first digits of SHA-256 over the parts joined by U+001F."""
    joined = F.concat_ws(UNIT, *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, length))


def uuid5(namespace: str, name: Column | str) -> Column:
    """Name-based UUID, version 5, of a namespace UUID and a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(_col(name), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def fold(c: Column | str) -> Column:
    """Lower case without diacritics; letters that are no base and mark (ß, ł, ø) stay."""
    return F.translate(F.lower(_col(c)), _FOLD_FROM, _FOLD_TO)


_MANY = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]  # their capitals are several letters, as SS
_ONE = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _MANY)


def capitalized(c: Column | str) -> Column:
    """The first letter as one capital letter, where there is one (ß becomes ẞ, not SS); the rest as it stands."""
    first = F.substring(_col(c), 1, 1)
    capital = F.when(F.length(F.upper(first)) > 1, F.translate(first, "".join(_MANY), _ONE)).otherwise(F.upper(first))
    return F.concat(capital, F.substring(_col(c), F.lit(2), F.length(_col(c))))


def safe_slug(c: Column | str, fallback: str = "item") -> Column:
    """Folded; every run of other characters than letters, digits, dot, underscore and dash becomes a dash; trimmed."""
    slug = F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.when(F.coalesce(F.length(slug), F.lit(0)) > 0, slug).otherwise(F.lit(fallback))


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: What NFC may change: combining marks, Hangul parts, and characters that only stand for others.
_COMPOSABLE = r"[\p{M}\u1100-\u11FF\u0340-\u0344\u0374\u037E\u0387\u1F71-\u1FFD\u2000\u2001\u2126\u212A\u212B\u2329\u232A\uF900-\uFAFF\uFB1D-\uFB4E]"


def nfc(c: Column | str) -> Column:
    """Unicode's composed form. Spark has no function for it: texts that hold something to compose go through Arrow, others stay."""
    t = _col(c)
    return F.coalesce(_composed(F.when(t.rlike(_COMPOSABLE), t)), t)


def normalize_search_text(c: Column | str, *, compose: bool = True) -> Column:
    """Composed (NFC), no-break spaces as spaces, runs of blanks as one, lines trimmed, blank lines dropped."""
    lines = F.split(F.regexp_replace(nfc(c) if compose else _col(c), "[  ]", " "), "\n", -1)
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " "))), lambda x: x != ""), "\n")


def is_heading(c: Column | str, markers: Sequence[str] = (), longest: int = 160) -> Column:
    """One line of at most `longest` characters that has letters, none of them small; or one of the markers."""
    t = F.trim(_col(c))
    shout = t.rlike(r"\p{L}") & ~t.rlike(r"\p{Ll}")
    return F.coalesce(~t.contains("\n") & (F.length(t) > 0) & (((F.length(t) <= longest) & shout) | t.isin(*markers)), F.lit(False))


def estimate_tokens(c: Column | str) -> Column:
    """At least 1: words and punctuation marks times 1.25, rounded half up."""
    n = F.regexp_count(_col(c), F.lit(r"(?U)\w+|[^\w\s]"))
    return F.greatest(F.lit(1), F.floor(F.coalesce(n, F.lit(0)) * 1.25 + 0.5)).cast("bigint")


def block_type(c: Column | str, place: str = "Locația:", period: str = "Perioada:") -> Column:
    """heading, list, municipal_event or paragraph."""
    text = F.trim(_col(c))
    lines = F.split(text, "\n", -1)
    listed = F.forall(lines, lambda x: F.trim(x).rlike(r"^[-•*]\s*\S"))
    event = F.exists(lines, lambda x: F.trim(x).startswith(place)) & F.exists(lines, lambda x: F.trim(x).startswith(period))
    mark = (F.size(lines) == 1) & text.rlike(r"^#+\s*\S")
    return F.when(is_heading(text) | mark, "heading").when(listed, "list").when(event, "municipal_event").otherwise("paragraph")


def tokenize_stem(c: Column | str, suffixes: Sequence[str] = (), keep: int = 4) -> Column:
    """Runs of two letters or more, lower case; the first suffix of the list that leaves `keep` letters is cut off."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"\p{L}{2,}"), F.lit(0))
    if not suffixes:
        return words
    return F.transform(words, lambda w: F.coalesce(*[F.when(w.endswith(s) & (F.length(w) - len(s) >= keep), w.substr(F.lit(1), F.length(w) - len(s))) for s in suffixes], w))


def _without_suffix(w: Column, suffixes: Sequence[str], keep: int) -> Column:
    return F.coalesce(*[F.when(w.endswith(s) & (F.length(w) - len(s) >= keep), w.substr(F.lit(1), F.length(w) - len(s))) for s in suffixes], w) if suffixes else w


def keywords(c: Column | str, stopwords: Sequence[str] = packs.STOPWORDS, suffixes: Sequence[str] = packs.RO_KEYWORD_SUFFIXES, least: int = 3, cut: int = 7, token: str = packs.KEYWORD_TOKEN) -> Column:
    """Folded words of `least` characters or more that are no stop words and no numbers, ASCII words without their suffix, cut
    to `cut` characters; each once, in the order of first sight."""
    words = F.regexp_extract_all(fold(c), F.lit(f"{token}{{{least},}}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.rlike("^[0-9]+$") & ~w.isin(*stopwords) if stopwords else ~w.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(F.when(w.rlike("^[a-z0-9]+$"), _without_suffix(w, suffixes, 4)).otherwise(w), 1, cut)))


def clip(c: Column | str, n: int) -> Column:
    """At most n characters: squeezed, cut at the last space if that keeps over half, without closing punctuation, with an ellipsis."""
    t = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    head = F.substring(t, 1, n - 1)
    at = F.length(head) - F.length(F.substring_index(head, " ", -1))
    head = F.when((F.instr(head, " ") > 0) & (at > n / 2), head.substr(F.lit(1), at - 1)).otherwise(head)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(head, r"[\s,.;:!?-]+$", ""), F.lit("…")))


def count_words(c: Column | str, words: Sequence[str]) -> Column:
    """How many words of the folded text are in the list."""
    tokens = F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.size(F.filter(tokens, lambda w: w.isin(*words)))


def detect_language(
    c: Column | str,
    hint: Column | str,
    lists: dict[str, Sequence[str]] = packs.FUNCTION_WORDS,
    marks: dict[str, str] = packs.MARKS,
    script: dict[str, str] = packs.SCRIPTS,
    default: str = packs.LANGUAGES[0],
    known: Sequence[str] | None = None,
) -> Column:
    """A script's language if the text has its letters; else the list with most hits; else, on a tie, a language's marks;
    else the hint, if it is known (or any, where known is not given); else the default."""
    t, asked = _col(c), _col(hint)
    out = [F.when(t.rlike(p), F.lit(k)) for k, p in script.items()]
    hits = {k: count_words(t, v) for k, v in lists.items()}
    for k, n in hits.items():
        others = [m for j, m in hits.items() if j != k]
        best = others[0] if len(others) == 1 else F.greatest(*others)
        out.append(F.when(n > best, F.lit(k)))
    out += [F.when(t.rlike(p), F.lit(k)) for k, p in marks.items()]
    return F.coalesce(*out, asked if known is None else F.when(asked.isin(*known), asked), F.lit(default))


def first_rule(c: Column | str, rules: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """The name of the first rule whose pattern the folded text has."""
    t = fold(c)
    return F.coalesce(*[F.when(t.rlike("(?U)" + p), F.lit(name)) for name, p in rules], otherwise)


def years_in(c: Column | str, longest: int = 20) -> Column:
    """Years 19xx and 20xx, and every year inside a range of at most `longest` years; ascending."""
    t = _col(c)
    single = F.transform(F.regexp_extract_all(t, F.lit(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"), F.lit(0)), lambda x: x.cast("int"))
    pattern = r"(?<![0-9])((?:19|20)[0-9]{2})\s*[-–—]\s*((?:19|20)[0-9]{2})(?![0-9])"
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("b"))

    def span(p: Column) -> Column:
        a, b = p["a"].cast("int"), p["b"].cast("int")
        return F.when((b >= a) & (b - a <= longest), F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_union(single, F.flatten(F.transform(pairs, span))))


def acronyms(c: Column | str, shape: str = packs.ACRONYM, no: Sequence[str] = packs.NOT_ACRONYMS) -> Column:
    """Runs of capitals of that shape that stand alone and are none of the others, each once."""
    found = F.regexp_extract_all(_col(c), F.lit(rf"(?U)\b{shape}\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*no)) if no else found)


def street_keys(c: Column | str, streets: Column | None = None, pattern: str = packs.STREET, no: Sequence[str] = packs.STREET_STOPWORDS) -> Column:
    """The distinctive (last) word of each street that is listed or that the folded text names: four characters or more, none
    of the words that go with any street."""
    named = F.regexp_extract_all(fold(c), F.lit("(?U)" + pattern), F.lit(1))
    if streets is not None:
        named = F.concat(F.coalesce(F.transform(streets, lambda x: fold(x)), F.array().cast("array<string>")), named)
    words = F.transform(named, lambda s: F.filter(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0)), lambda w: ~w.isin(*no)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: F.element_at(w, -1)))


def sectors_in(c: Column | str, *, explicit_only: bool = False, names: Sequence[str] = tuple(packs.SECTORS), common: Sequence[str] = ("centru",)) -> Column:
    """Districts that the folded text names after the word sector, or, unless only those are asked for, anywhere; a name that
    is a common word too counts only after sector."""
    t = fold(c)
    after = {n: t.rlike(rf"(?U)\bsector\w*\s+{n}\b") for n in names}
    has = {n: a if explicit_only or n in common else a | t.rlike(rf"(?U)\b{n}\b") for n, a in after.items()}
    return F.array_sort(F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in has.items()])))


def named_in(c: Column | str, names: Sequence[str]) -> Column:
    """Those folded names of a gazetteer that the folded text has as whole words."""
    t = fold(c)
    return F.array_compact(F.array(*[F.when(t.rlike(rf"(?<![\p{{L}}]){n}(?![\p{{L}}])"), F.lit(n)) for n in names]))


def valid_url(c: Column | str) -> Column:
    u = _col(c)
    return F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")).isin("http", "https") & (F.length(F.try_parse_url(u, F.lit("HOST"))) > 0), F.lit(False))


def first_url(urls: Column | str) -> Column:
    return F.try_element_at(F.filter(_col(urls), lambda u: u.rlike("^https?://")), F.lit(1))


def url_basename(c: Column | str) -> Column:
    """Last part of the path, decoded."""
    path = F.regexp_replace(F.regexp_extract(_col(c), r"^[a-z]+://[^/?#]*(/[^?#]*)?", 1), "/+$", "")
    return F.coalesce(F.try_url_decode(F.element_at(F.split(path, "/"), -1)), F.lit(""))


def file_key(c: Column | str, least: int = 5) -> Column:
    """Folded file name of a URL, whatever its host; null if it is no file or its stem is short."""
    name = fold(url_basename(c))
    stem = F.regexp_extract(name, r"^(.+)\.[a-z0-9]{2,5}$", 1)
    return F.when(F.length(stem) >= least, name)


def is_anchor_title(c: Column | str, words: str = r"vezi|detalii|descarca|citeste|click|aici|link|download|here") -> Column:
    return F.coalesce(fold(c).rlike(rf"^\W*(?:{words})(?:\W.*)?$"), F.lit(True))


def is_file_title(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"(?i)^\S+\.(?:pdf|docx?|xlsx?|pptx?|odt|rtf|zip|jpe?g|png)$"), F.lit(False))


def normalize_label(c: Column | str) -> Column:
    """Folded, with every run of other characters than letters, digits and underscore as one space."""
    return F.trim(F.regexp_replace(fold(c), r"(?U)[^\w]+", " "))


def title_key(c: Column | str, least: int = 30) -> Column:
    """Normalised title if it is long enough and no link text or file name."""
    key = normalize_label(c)
    return F.when((F.length(key) >= least) & ~is_anchor_title(c) & ~is_file_title(c), key)


def display_date(c: Column | str) -> Column:
    return F.date_format(parse_iso_date(c), "dd.MM.yyyy")


def shorten(c: Column | str, n: Column | int) -> Column:
    """At most n characters, squeezed and without closing punctuation; cut at the last space if that keeps over half."""
    n = F.lit(n) if isinstance(n, int) else n
    edge = r"^[ ,;:—-]+|[ ,;:—-]+$"
    t = F.regexp_replace(F.regexp_replace(_col(c), r"(?U)\s+", " "), edge, "")
    head = t.substr(F.lit(1), F.greatest(F.lit(1), n - 1))
    at = F.length(head) - F.length(F.substring_index(head, " ", -1))
    cut = F.when((F.instr(head, " ") > 0) & (at > F.floor(n / 2)), head.substr(F.lit(1), at - 1)).otherwise(head)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:—-]+$", ""), F.lit("…")))


def readable_subject(title: Column | str, url: Column | str, act: str = packs.ACT_TITLE) -> Column:
    """What a document is about, for a choice: an act's kind and number with its subject; `Nr. n` and the subject of a numbered
    title; the title itself if it is no link text or file name; else words of the file's name; else the title's first part."""
    t = F.trim(F.regexp_replace(F.coalesce(_col(title), F.lit("")), r"(?U)\s+", " "))
    with_rest = lambda head, rest: F.concat(head, F.when(F.length(rest) > 0, F.concat(F.lit(" — "), rest)).otherwise(""))
    kind, number = F.regexp_extract(t, "(?iU)" + act, 1), F.regexp_extract(t, "(?iU)" + act, 2)
    rest = F.regexp_replace(t, "(?iU)" + act, "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"^\s*(?:din\s+[\d.\-/]+\s*)?", ""), r"(?iU)^[\s—–-]*(?:cu privire la\s+)?", "")
    act_label = with_rest(F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 100)), F.lit(" nr. "), number), rest)
    numbered = r"(?iU)^\s*(?:nr\.?\s*)?(\d[\w/.-]*)\s+din\s+[\d.\-/]+\s*[—–-]?\s*(?:cu privire la\s+)?"
    plain = ~is_anchor_title(t) & ~is_file_title(t) & (F.length(t) > 0)
    stem = F.regexp_replace(F.regexp_replace(url_basename(url), r"(?i)\.(?:pdf|docx?|xlsx?|odt|ods|rtf|pptx?|jpe?g|png|zip|rar)$", ""), r"^\d{6,}[_-]*", "")
    name = F.trim(F.regexp_replace(stem, r"[_+]+|(?<=[^\d])-|-(?=[^\d])", " "))
    long_words = F.filter(F.regexp_extract_all(name, F.lit(r"\p{L}{3,}"), F.lit(0)), lambda w: fold(w) != "scan")
    first = F.trim(F.element_at(F.split(F.regexp_replace(t, "_", " "), r"(?iU)\s+aici\b|\s+click\b|\s,|,", 2), 1))
    return (
        F.when(F.length(number) > 0, act_label)
        .when(t.rlike(numbered), with_rest(F.concat(F.lit("Nr. "), F.regexp_extract(t, numbered, 1)), F.regexp_replace(t, numbered, "")))
        .when(plain, t)
        .when((F.size(long_words) > 0) & (F.size(F.split(name, r"\s+")) >= 2), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 10_000)))
        .otherwise(F.coalesce(F.when(F.length(first) > 0, first), F.when(F.length(t) > 0, t), F.lit("Document")))
    )


def choice_label(subject: Column, publisher: Column, published: Column, n: int = 110, detail: Column | None = None) -> Column:
    """subject · publisher · dd.mm.yyyy without missing parts, at most n characters. A subject of one or two words is followed
    by the detail, where there is one."""
    part = lambda x: F.when(F.length(F.trim(x)) > 0, F.trim(x))
    if detail is not None:
        brief = F.size(F.regexp_extract_all(fold(subject), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) <= 2
        subject = F.when(brief & part(detail).isNotNull(), F.concat(subject, F.lit(": "), part(detail))).otherwise(subject)
    suffix = F.concat_ws(" · ", part(publisher), display_date(published))
    room = F.greatest(F.lit(20), n - F.length(suffix) - 3)
    return F.when(F.length(suffix) == 0, shorten(subject, n)).otherwise(F.concat(shorten(subject, room), F.lit(" · "), suffix))


def clean_title(c: Column | str, suffix: str = packs.TITLE_SUFFIX) -> Column:
    """Squeezed, without a closing site name, at most two."""
    once = lambda x: F.trim(F.regexp_replace(x, "(?iU)" + suffix, ""))
    return once(once(F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))))


def title_noise(c: Column | str, pattern: str = packs.TITLE_NOISE) -> Column:
    """The folded title is that of a form, report or list and names no news."""
    return F.coalesce(fold(c).rlike("(?iU)" + pattern), F.lit(False))


def clean_text(c: Column | str, title: Column | str) -> Column:
    """Without Markdown marks, squeezed, without the title if the text opens with its first 60 characters."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(c), r"(?mU)^\s*#+\s*", ""), r"[*_`>|]+", " "), r"(?U)\s+", " "))
    head = _col(title)
    opens = (F.length(head) > 0) & F.startswith(fold(t), F.substring(fold(head), 1, 60))
    return F.when(opens, F.regexp_replace(t.substr(F.length(head) + 1, F.length(t)), "^[ .:–-]+", "")).otherwise(t)


def split_sentences(c: Column | str, abbreviations: Sequence[str] = packs.ABBREVIATIONS, *, without_marks: bool = False) -> Column:
    """Cut after . ! ? … and white space before a capital, digit, quote or bracket, unless what stands before a full stop is
    an abbreviation, a single letter or a number of one or two digits. without_marks takes [S1] marks out first."""
    words, text = "|".join(abbreviations), _col(c)
    if without_marks:
        text = F.regexp_replace(F.regexp_replace(text, r"\[S[1-9][0-9]*\]", ""), r"[ \t]+([.,;:!?])", "$1")
    pattern = rf"(?iu)(?<=[.!?…])(?<!(?<![\p{{L}}\p{{N}}])(?:{words}|\p{{L}}|[0-9]{{1,2}})\.)\s+(?-i)(?=[\p{{Lu}}\p{{N}}\"'(„«\[])"
    return F.filter(F.transform(F.split(F.trim(text), pattern, -1), lambda s: F.trim(s)), lambda s: s != "")


def markers(c: Column | str) -> Column:
    """The numbers of [S1] marks, in order, repeats included."""
    return F.regexp_extract_all(_col(c), F.lit(r"\[(S[0-9]+)\]"), F.lit(1))


def uncited_sentences(c: Column | str, known: Column, least_words: int = 4) -> Column:
    """Sentences of least_words words or more without a mark, or with one that is not known."""

    def bad(s: Column) -> Column:
        ids = markers(s)
        words = F.size(F.filter(F.split(F.trim(F.regexp_replace(s, r"\[S[0-9]+\]", " ")), r"\s+"), lambda w: w != ""))
        return (words >= least_words) & ((F.size(ids) == 0) | (F.size(F.array_except(ids, known)) > 0))

    return F.filter(split_sentences(c), bad)


def uncited_segments(c: Column | str, known: Column) -> Column:
    """Parts of an answer that break its citations: a sentence without a mark, or with one that is not known, or several
    sentences before one run of marks. A part is what stands before a run of marks, or after the last."""
    run = r"(?:\s*\[S[1-9][0-9]*\])+"
    t = F.coalesce(_col(c), F.lit(""))
    parts = F.transform(F.split(t, run, -1), lambda p: F.trim(p))
    runs = F.transform(F.regexp_extract_all(t, F.lit(run), F.lit(0)), lambda r: markers(r))
    pairs = F.zip_with(parts, runs, lambda p, r: F.struct(p.alias("text"), F.coalesce(r, F.array().cast("array<string>")).alias("ids")))
    bad = lambda x: (F.length(x["text"]) > 0) & ((F.size(x["ids"]) == 0) | (F.size(F.array_except(x["ids"], known)) > 0) | (F.size(split_sentences(x["text"], without_marks=True)) != 1))
    return F.transform(F.filter(pairs, bad), lambda x: x["text"])


def fact_matches(c: Column | str, patterns: dict[str, str] = packs.FACTS) -> Column:
    """A struct of lists: all matches of each family (amounts, dates, durations, counts), in order, repeats included."""
    return F.struct(*[all_matches(c, p).alias(k) for k, p in patterns.items()])


def parse_event(c: Column | str, place: str = "Locația:", period: str = "Perioada:") -> Column:
    """(title, location, period_raw, unrecognized) of an event's lines: those before its place or period make the title, those
    after them are not recognised; closing full stops go, empty values are null."""
    lines = F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), r"\R", -1), lambda x: F.trim(x)), lambda x: x != "")
    kept = lambda x: F.when(F.length(x) > 0, x)
    value = lambda mark: F.element_at(F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: kept(F.regexp_replace(F.trim(x.substr(F.lit(len(mark) + 1), F.length(x))), r"\.+$", ""))), -1)
    some = lambda mark: F.when(F.exists(lines, lambda x: x.startswith(mark)), value(mark))
    labelled = lambda x: x.startswith(place) | x.startswith(period)
    filled = lambda x: x.rlike(f"^(?:{place}|{period})[\\s.]*[^\\s.]")
    first = F.array_position(F.transform(lines, filled), F.lit(True))
    at = F.when(first > 0, first).otherwise(F.size(lines) + 1).cast("int")
    plain = lambda part: F.filter(part, lambda x: ~labelled(x))
    title = kept(F.regexp_replace(F.array_join(plain(F.slice(lines, F.lit(1), at - 1)), " "), r"\.+$", ""))
    return F.struct(title.alias("title"), some(place).alias("location"), some(period).alias("period_raw"), plain(F.slice(lines, at, F.size(lines) + 1)).alias("unrecognized"))


def doc_type(declared: Column | str, source_type: Column | str) -> Column:
    """The declared type unless it is unknown, else one by the source."""
    d, s = _col(declared), _col(source_type)
    by_source = F.when(s.isin("derived_web_text", "webpage"), "webpage_article").when(s == "pdf", "administrative_document").otherwise("municipal_document")
    return F.when(d.isNotNull() & (d != "unknown"), d).otherwise(by_source)


def evidence_kind(c: Column | str) -> Column:
    """table, list, headline or body, by a passage's type."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.when(t.contains("table"), "table").when(t.contains("list") | t.contains("item"), "list").when(t.contains("heading") | t.contains("headline"), "headline").otherwise("body")


def speech_text(c: Column | str) -> Column:
    """Text to be read aloud: links become their words, URLs, marks and Markdown go."""
    t = F.regexp_replace(_col(c), r"\[([^\]]*)\]\([^)]*\)", "$1")
    for pattern, to in ((r"https?://\S+", " "), (r"\[S[0-9]+\]", " "), (r"[*_`#>|]+", " "), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def all_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit("(?iU)" + pattern), F.lit(0))


def parse_iso_date(c: Column | str) -> Column:
    return F.try_to_date(F.substring(_col(c).cast("string"), 1, 10), "yyyy-MM-dd")


def contains_any(c: Column | str, phrases: Sequence[str]) -> Column:
    """The folded text, apostrophes straight, has one of the folded phrases."""
    t = F.regexp_replace(fold(c), "[‘’]", "'")
    out = F.lit(False)
    for p in phrases:
        out = out | F.coalesce(t.contains(folded(p)), F.lit(False))
    return out


def recency_bucket(ts: Column | str, today: Column) -> Column:
    days = F.date_diff(today, F.to_date(_col(ts)))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "last_7_days").when(days <= 30, "last_30_days").otherwise("older")


def first_non_blank(*cs: Column | str) -> Column:
    return F.coalesce(*[F.when(F.length(F.trim(_col(c))) > 0, F.trim(_col(c))) for c in cs])


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """The vector at length 1; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(_col(v), lambda x: x.cast("double") / norm))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine cut to -1..1; null if either is zero or they differ in length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(_col(a)) == F.size(_col(b))) & (n > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def hash_embedding(c: Column | str, dims: int = 16) -> Column:
    """A vector of -1..1 that is the same for the same text and means nothing."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", _col(c), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF) * 2 - 1)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Set similarity of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(_col(a), _col(b))).cast("double"), F.size(F.array_union(_col(a), _col(b))).cast("double")), F.lit(0.0))
