"""Script-aware text functions.  All return Columns and run inside the JVM."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN_RANGE = "\\x{3400}-\\x{9fff}"

# Combining marks of the four tones, in tone order.
TONE_MARKS = "̄́̌̀"

# Full-width forms of ASCII punctuation.
FULL_WIDTH = {",": "，", "!": "！", "?": "？", ":": "：", ";": "；", "(": "（", ")": "）"}

# Legal toneless pinyin syllables.
SYLLABLE = ("^(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(?:a|o|e|ai|ei|ao|ou|an|en|ang|eng|ong|i|ia|ie|iao|iu|ian|in|iang|ing|"
            "iong|u|ua|uo|uai|ui|uan|un|uang|ueng|ü|üe|üan|ün|er)$")

# Vowels of pinyin with and without tone marks.
PINYIN_VOWELS = "aeiouüvāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ"

# Pinyin initials, finals and whole syllables without an initial, in Russian letters.
INITIALS_RU = {"b": "б", "p": "п", "m": "м", "f": "ф", "d": "д", "t": "т", "n": "н", "l": "л", "g": "г", "k": "к", "h": "х",
               "j": "цз", "q": "ц", "x": "с", "zh": "чж", "ch": "ч", "sh": "ш", "r": "ж", "z": "цз", "c": "ц", "s": "с"}
FINALS_RU = {"a": "а", "o": "о", "e": "э", "ai": "ай", "ei": "эй", "ao": "ао", "ou": "оу", "an": "ань", "en": "энь",
             "ang": "ан", "eng": "эн", "ong": "ун", "er": "эр", "i": "и", "ia": "я", "ie": "е", "iao": "яо", "iu": "ю",
             "ian": "янь", "in": "инь", "iang": "ян", "ing": "ин", "iong": "юн", "u": "у", "ua": "уа", "uo": "о",
             "uai": "уай", "ui": "уй", "uan": "уань", "un": "унь", "uang": "уан", "v": "юй", "ve": "юэ", "ue": "юэ",
             "van": "юань", "vn": "юнь"}
BARE_SYLLABLES_RU = {"yi": "и", "ya": "я", "ye": "е", "yao": "яо", "you": "ю", "yan": "янь", "yin": "инь", "yang": "ян",
                     "ying": "ин", "yong": "юн", "yu": "юй", "yue": "юэ", "yuan": "юань", "yun": "юнь", "wu": "у",
                     "wa": "ва", "wo": "во", "wai": "вай", "wei": "вэй", "wan": "вань", "wen": "вэнь", "wang": "ван",
                     "weng": "вэн"}
# Fixed value: the pattern of one pinyin syllable.
PINYIN_PART = ("(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(iang|iong|uang|ueng|uai|uan|van|ian|iao|ang|eng|ing|ong|ai|ei|ao|ou|an|"
               "en|in|un|vn|ia|ie|iu|ua|uo|ui|ue|ve|er|a|o|e|i|u|v)(?![aeiouv]|ng?(?![aeiouv]))")

# Credential patterns.
CREDENTIALS = {
    "api_key": r"\bsk-(?:proj-|or-v1-)?[A-Za-z0-9_-]{25,}\b",
    "gh_token": r"\bgh[pousr]_[A-Za-z0-9]{25,}\b",
    "github_pat": r"\bgithub_pat_[A-Za-z0-9_]{25,}\b",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


def _composed_letters(*ranges):
    """(letter, NFD form) for every precomposed letter of some ranges, from the Unicode tables."""
    for cp in (cp for r in ranges for cp in r):
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        if nfd != ch:
            yield ch, nfd


_LATIN = list(_composed_letters(range(0x00C0, 0x0250), range(0x1E00, 0x1F00)))
_LETTERS = [*_LATIN, *_composed_letters(range(0x0400, 0x0530))]  # and Cyrillic
_ACCENTED = "".join(c for c, _ in _LETTERS)
_BASES = "".join(d[0] for _, d in _LETTERS)
_TWO_MARKS = "".join(c for c, d in _LETTERS if len(d) == 3)
_TONED = [(c, d) for c, d in _LATIN if any(m in d for m in TONE_MARKS)]
_TONED_FROM = "".join(c for c, _ in _TONED) + TONE_MARKS
# Control characters stand for tones and marks while counting: their classes are short ranges.
_TONE_SIGNS = "\x01\x02\x03\x04"
_TONED_SIGN = "".join(_TONE_SIGNS[next(TONE_MARKS.index(m) for m in d if m in TONE_MARKS)] for _, d in _TONED) + _TONE_SIGNS
_MARK_SIGNS = "".join("\x02" if len(d) == 3 else "\x01" for _, d in _LETTERS)
_TONELESS_PAIRS = [(c, unicodedata.normalize("NFC", "".join(x for x in d if x not in TONE_MARKS))) for c, d in _TONED]
_TONED_SINGLE = "".join(c for c, _ in _TONELESS_PAIRS)
_TONED_BARE = "".join(b[0] for _, b in _TONELESS_PAIRS)
# Entries of a letter, a combining mark, the letter they make and a blank.
_COMPOSE = "".join(unicodedata.normalize("NFC", d[:-1]) + d[-1] + c + " " for c, d in _LETTERS)
_NOT_ASCII = "[^\\x00-\\x7f]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def nfc(col: Column) -> Column:
    """Composed form of Latin and Cyrillic letters; text without combining marks passes through untouched."""
    marked = "\\p{L}[\\x{0300}-\\x{036f}]"
    def compose(text):
        pairs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({marked})"), F.lit(1)))
        def replace(s, pair):
            at = F.instr(F.lit(_COMPOSE), pair)
            return F.when(at > 0, F.replace(s, pair, F.substring(F.lit(_COMPOSE), at + 2, F.lit(1)))).otherwise(s)
        return F.aggregate(pairs, text, replace)
    # The second pass is for letters with two marks.
    return F.when(col.rlike(marked), compose(compose(col))).otherwise(col)


def strip_accents(col: Column) -> Column:
    return F.when(col.rlike(_NOT_ASCII), F.regexp_replace(F.translate(col, _ACCENTED, _BASES), "\\p{M}+", "")).otherwise(col)


def count_chars(col: Column, char_class: str) -> Column:
    """Number of characters of a class such as ``\\p{IsHan}``."""
    return F.length(F.regexp_replace(col, f"[^{char_class}]+", "")).cast("long")


def script_profile(col: Column) -> Column:
    """Counts of Han, Latin, digit and other characters."""
    han, latin, digit = (count_chars(col, c) for c in ("\\p{IsHan}", "\\p{IsLatin}", "\\p{Nd}"))
    return F.struct(han.alias("han"), latin.alias("latin"), digit.alias("digit"),
                    (F.length(col).cast("long") - han - latin - digit).alias("other"))


def has_ascii_letter(col: Column) -> Column:
    return col.rlike("[A-Za-z]")


def speakable(col: Column, limit: int = 120) -> Column:
    """Text that may be spoken: 1..limit characters after collapsing blanks, with a Han character."""
    text = F.trim(F.regexp_replace(col, "\\s+", " "))
    return F.length(text).between(1, limit) & text.rlike(f"[{HAN_RANGE}]")


def plain_key(col: Column) -> Column:
    """Letters and digits only, without accents, in lower case."""
    return F.regexp_replace(F.lower(strip_accents(col)), "[^\\p{L}\\p{N}]+", "")


def toneless(col: Column) -> Column:
    bare = F.regexp_replace(F.translate(col, _ACCENTED, _BASES), "[\\x{0300}-\\x{036f}]+", "")
    return F.lower(F.when(col.rlike(_NOT_ASCII), bare).otherwise(col))


def tone_count(col: Column) -> Column:
    """Number of combining marks of the decomposed text."""
    signs = F.regexp_replace(F.translate(col, _ACCENTED, _MARK_SIGNS), "[^\\x01\\x02\\x{0300}-\\x{036f}]+", "")
    marks = let(signs, lambda m: F.length(m) + F.length(F.regexp_replace(m, "[^\\x02]+", "")))
    return F.when(col.rlike(_NOT_ASCII), marks).otherwise(0).cast("long")


def memory_key(col: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(nfc(col), "\\s+", " ")))


def compact_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, "\\s+", ""))


def widen_punctuation(col: Column) -> Column:
    """ASCII marks beside Han characters become full-width."""
    out = col
    for mark in ",!?:;)":  # the bracket last: a widened bracket must not widen the mark after it
        out = F.regexp_replace(out, f"(?<=[\\p{{IsHan}}”’）])\\s*[{mark}]", FULL_WIDTH[mark])
    for mark in ",!?:;(":
        out = F.regexp_replace(out, f"[{mark}]\\s*(?=\\p{{IsHan}})", FULL_WIDTH[mark])
    return F.regexp_replace(out, "(?<=\\p{IsHan})\\s*\\.(?=\\s*$|\\s*\\p{IsHan}|\\s*\\n)", "。")


_WORD = f"[\\p{{L}}\\p{{Nl}}\\p{{No}}&&[^{HAN_RANGE}]]+"
TOKEN = f"[{HAN_RANGE}]|{_WORD}(?:['’]{_WORD})*|\\p{{Nd}}+|\\S"


def mixed_tokens(col: Column) -> Column:
    """Array of tokens: one Han character, a word with inner apostrophes, a digit run or one symbol."""
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))


def _tone_digits(col: Column) -> Column:
    signs = F.regexp_replace(F.translate(col, _TONED_FROM, _TONED_SIGN), "[^\\x01-\\x04]+", "")
    return F.when(col.rlike(_NOT_ASCII), F.translate(signs, _TONE_SIGNS, "1234")).otherwise("")


def tone_of(col: Column) -> Column:
    """1..4 when the text carries exactly one kind of tone mark, else null."""
    tones = F.array_distinct(F.filter(F.split(_tone_digits(col), ""), lambda c: c != ""))
    return F.when(F.size(tones) == 1, tones[0].cast("int"))


def tone_key(col: Column) -> Column:
    """Syllable plus tone digit, with v for u-umlaut; null unless one legal syllable with one mark."""
    text = F.lower(F.trim(nfc(col)))
    digits = _tone_digits(text)
    bare = F.regexp_replace(F.translate(text, _TONED_SINGLE, _TONED_BARE), f"[{TONE_MARKS}]", "")
    return F.when((F.length(digits) == 1) & bare.rlike(SYLLABLE), F.concat(F.replace(bare, F.lit("ü"), F.lit("v")), digits))


def syllable_count(col: Column) -> Column:
    """Vowel groups of a pinyin word; a final r after another sound is a syllable of its own."""
    w = F.regexp_replace(F.lower(nfc(col)), f"[^a-z{PINYIN_VOWELS}']+", "")
    groups = F.regexp_count(w, F.lit(f"[{PINYIN_VOWELS}]+")).cast("long")
    extra = (F.length(w) > 2) & ~w.rlike("(^|')[eēéěè]r$") & w.rlike(f"[{PINYIN_VOWELS}ng]r$")
    return groups + F.when(extra, 1).otherwise(0)


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.element_at(entries, key)


def _irregular_syllables() -> dict[str, str]:
    """Syllables whose Russian form is not that of their initial and final put together."""
    table = {spelled: sound for whole, sound in BARE_SYLLABLES_RU.items() for spelled in (whole[0] + "i" + whole[1:], whole[0] + "u" + whole[1:])}
    table |= BARE_SYLLABLES_RU
    table |= {i + "i": INITIALS_RU[i] + ("ы" if i in ("z", "c", "s") else "и") for i in ("zh", "ch", "sh", "r", "z", "c", "s")}
    # After j, q and x a written u is an umlaut.
    for final in ("u", "ua", "uo", "uai", "ui", "ue", "uan", "un", "uang", "ueng"):
        umlaut = "v" + final[1:]
        table |= {i + final: INITIALS_RU[i] + FINALS_RU.get(umlaut, umlaut) for i in ("j", "q", "x")}
    return table


def _part_ru(part: Column) -> Column:
    """One syllable: an irregular one as a whole, any other as initial and final; y and w alone have no sound."""
    initial = F.regexp_extract(part, f"^({'|'.join(sorted([*INITIALS_RU, 'y', 'w'], key=len, reverse=True))})?", 0)
    final = F.substring(part, F.length(initial) + 1, F.length(part))
    regular = F.concat(F.coalesce(_lookup(INITIALS_RU, initial), F.lit("")), F.coalesce(_lookup(FINALS_RU, final), final))
    return F.coalesce(_lookup(_irregular_syllables(), part), regular)


def bare_pinyin(col: Column) -> Column:
    """Lower-case letters without tones, u-umlaut as v."""
    umlauts = "üǖǘǚǜÜǕǗǙǛ"
    text = F.regexp_replace(F.translate(col, umlauts, "v" * len(umlauts)), "u\\x{0308}", "v")
    return toneless(text)


def transliterate(col: Column) -> Column:
    """Pinyin to Russian letters word by word; null when any part is not pinyin."""
    bare = bare_pinyin(col)
    words = F.filter(F.split(bare, "[^a-zv']+"), lambda w: w != "")
    def parts(w):
        return F.regexp_extract_all(w, F.lit(PINYIN_PART), F.lit(0))
    # Nothing is left if every letter lies in a syllable that begins where the last one ends.
    parses = F.regexp_replace(bare, f"\\G(?:[^a-zv]|{PINYIN_PART})", "") == ""
    def ru(w):
        joined = F.array_join(F.transform(F.flatten(F.transform(F.split(w, "'"), parts)), _part_ru), "")
        return F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined)))
    # Text that is not pinyin is never taken apart.
    return F.when(bare.rlike("[a-zv']") & parses, F.array_join(F.transform(words, ru), " "))


def track_code(col: Column) -> Column:
    """``lesson-track`` from a file name, without leading zeros; null when there is none."""
    name = F.regexp_replace(col, "(?i)\\.(mp3|m4a|aac|ogg|wav)$", "")
    # Fixed value: the pattern of a track number.
    pattern = "(?:^|[^0-9])([0-9]{1,2})\\s*[-_–—.]\\s*([0-9]{1,3})(?:[^0-9]|$)"
    a, b = (F.regexp_extract(name, pattern, g) for g in (1, 2))
    return F.when(a != "", F.concat_ws("-", a.cast("int"), b.cast("int")))


def text_weight(col: Column) -> Column:
    """Estimated printed width: Han 1, thin marks .27, wide letters .85, others .53."""
    han = count_chars(col, "\\p{IsHan}")
    thin = count_chars(col, "ilI'.,:;\\s")
    wide = count_chars(col, "mwMW")
    return han + thin * 0.27 + wide * 0.85 + (F.length(col) - han - thin - wide) * 0.53


def drop_repeated_lines(native: Column, english: Column) -> Column:
    """Native text without its Latin-only lines that the English field already holds."""
    def clean(c):
        return F.trim(F.regexp_replace(c, "\\s+", " "))
    known = clean(english)
    def repeated(line):
        return line.rlike("[A-Za-z]") & ~line.rlike("\\p{IsHan}") & F.contains(known, clean(line))
    kept = F.array_join(F.filter(F.split(native, "\n"), lambda l: ~repeated(l)), "\n")
    return F.when(F.contains(native, F.lit("\n")) & (F.coalesce(english, F.lit("")) != ""), kept).otherwise(native)


# Fixed value: the pattern of a run of Chinese text with its marks and digits.
_CJK_RUN = (f"[①-⑳0-9]*\\s*[{HAN_RANGE}]+(?:[0-9\\s，。！？：；、“”‘’（）《》【】—…·]*[{HAN_RANGE}]+)*")


def split_language_layers(source: Column, pinyin: Column) -> Column:
    """Mixed text as struct(native, pinyin, english).

    Native runs are joined by a blank.  The English layer loses the tokens of the reading, whatever their case, and circled
    digits; a reading without any tone mark is none.
    """
    def tidy(c):
        return F.trim(F.regexp_replace(c, "\\s+", " "))
    def tokens(reading):
        # Words of small ASCII letters are passed over, as they have neither a tone mark nor capitals.
        pieces = F.regexp_extract_all(reading, F.lit(f"[a-z]++(?!\\p{{L}})|([A-Z]{{2,}}|\\p{{L}}+|[①-⑳{TONE_MARKS}])"), F.lit(1))
        toned = F.filter(pieces, lambda t: (t != "") & ((F.length(_tone_digits(t)) > 0) | t.rlike("^[A-Z]{2,}$") | t.rlike("^[①-⑳]$")))
        return F.when(F.length(_tone_digits(reading)) > 0, toned).otherwise(F.array().cast("array<string>"))
    def english(s):
        read = F.transform(F.filter(s["toned"], lambda t: t.rlike("\\p{L}")), F.lower)
        words, lower = F.split(s["latin"], " "), F.split(F.lower(s["latin"]), " ")
        # Only words that go are looked for, toned ones apart from those of ASCII letters.
        def kept(g):
            gone = lambda w: F.when(w.rlike(_NOT_ASCII), F.array_contains(g["toned"], F.lower(w))).otherwise(F.array_contains(g["plain"], F.lower(w)))
            return F.array_join(F.filter(words, lambda w: ~gone(w)), " ")
        def split(gone):
            ascii = lambda keep: F.filter(gone, lambda t: t.rlike(_NOT_ASCII) != F.lit(keep))
            return F.when(F.size(gone) > 0, let(F.struct(ascii(False).alias("toned"), ascii(True).alias("plain")), kept)).otherwise(s["latin"])
        return F.when(F.size(s["toned"]) > 0, let(F.array_intersect(lower, read), split)).otherwise(s["latin"])
    def layers(s):
        return F.struct(F.regexp_replace(F.array_join(s["runs"], " "), "^\\s+|\\s+$", "").alias("native"),
                        F.coalesce(F.array_join(s["toned"], " "), F.lit("")).alias("pinyin"), tidy(F.regexp_replace(english(s), "[①-⑳]", " ")).alias("english"))
    def taken(s):
        runs = F.regexp_extract_all(s["source"], F.lit(_CJK_RUN), F.lit(0))
        return let(F.struct(runs.alias("runs"), tidy(F.regexp_replace(s["source"], _CJK_RUN, " ")).alias("latin"), tokens(s["pinyin"]).alias("toned")), layers)
    return let(F.struct(source.alias("source"), pinyin.alias("pinyin")), taken)


def proximity_flag(col: Column, trigger: str, target: str, negation: str, near: int = 70, before: int = 35) -> Column:
    """Excerpt around the first trigger that has a target within ``near`` characters and no negation just before; else null."""
    hits = F.regexp_extract_all(col, F.lit(f"({trigger})"), F.lit(1))
    gaps = F.split(col, trigger, -1)
    start = F.struct(F.lit("").alias("edge"), F.array().cast("array<string>").alias("out"))
    def right(text, n):
        return F.when(F.length(text) > n, F.substring(text, F.length(text) - n + 1, F.lit(n))).otherwise(text)
    # Going forward, the text before each hit is the end of what came so far and the gap.
    def forward(acc, piece):
        before_ = right(F.concat(acc["edge"], piece["gap"]), near)
        return F.struct(right(F.concat(before_, piece["hit"]), near).alias("edge"), F.concat(acc["out"], F.array(before_)).alias("out"))
    # Going back, the text after each hit is the gap and the start of what follows.
    def backward(acc, piece):
        after = F.substring(F.concat(piece["gap"], acc["edge"]), 1, near)
        return F.struct(F.substring(F.concat(piece["hit"], after), 1, near).alias("edge"), F.concat(acc["out"], F.array(after)).alias("out"))
    def pieces(of):
        return F.zip_with(hits, of, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    n = F.size(hits)
    lead = F.aggregate(pieces(F.slice(gaps, F.lit(1), n)), start, forward, lambda acc: acc["out"])
    trail = F.reverse(F.aggregate(F.reverse(pieces(F.slice(gaps, F.lit(2), n))), start, backward, lambda acc: acc["out"]))
    spots = F.zip_with(F.zip_with(lead, hits, lambda b, h: F.struct(b.alias("b"), h.alias("h"))), trail,
                       lambda s, a: F.struct(s["b"].alias("b"), F.concat(s["b"], s["h"], a).alias("around")))
    good = F.filter(spots, lambda s: ~right(s["b"], before).rlike(negation) & s["around"].rlike(target))
    found = F.trim(F.regexp_replace(good[0]["around"], "\\s+", " "))
    return F.when(col.rlike(trigger) & col.rlike(target), F.when(F.size(good) > 0, found))


def spoken_match(target: Column, heard: Column) -> Column:
    """Equal after removing blanks and punctuation; an empty side never matches."""
    def bare(c):
        return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s\\p{P}\\p{S}]+", ""))
    return (bare(target) != "") & (bare(target) == bare(heard))


def clamp_rating(col: Column) -> Column:
    """Rounded (halves up) to 1..5; null and not-a-number give null."""
    v = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(col.cast("double") + 0.5))).cast("int")
    return F.when(col.isNotNull() & ~F.isnan(col.cast("double")), v)


def layer_counts(html: Column, attributes: list[str]) -> Column:
    """Map of attribute marker to its number of occurrences."""
    return F.create_map(*[x for a in attributes for x in (F.lit(a), F.regexp_count(html, F.lit(f"{a}=")).cast("long"))])


def missing_layers(html: Column, attributes: list[str]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(~F.contains(html, F.lit(f"{a}=")), F.lit(a)) for a in attributes])), ",")
