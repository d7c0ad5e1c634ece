"""Text to columns: folding, fingerprints, snippets, masks, HTML, CSV cells, cues. All stay in JVM expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks of letters whose accents folding removes; the table is derived from Unicode's decompositions.
_BLOCKS = ((0x00C0, 0x0250), (0x1E00, 0x1F00))


def _fold_table() -> tuple[str, str]:
    """Accented letters and their plain ones, one for one."""
    pairs = {}
    for lo, hi in _BLOCKS:
        for c in map(chr, range(lo, hi)):
            plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if plain != c and len(plain) == 1:
                pairs[c] = plain.lower()
    pairs |= {"đ": "d", "Đ": "d"}
    return "".join(pairs), "".join(pairs.values())


def _compose_table() -> tuple[tuple[str, str], ...]:
    """Letters with combining marks, decomposed and composed, longest first."""
    pairs = {unicodedata.normalize("NFD", c): c for lo, hi in _BLOCKS for c in map(chr, range(lo, hi)) if unicodedata.normalize("NFD", c) != c and unicodedata.normalize("NFC", c) == c}
    return tuple(sorted(pairs.items(), key=lambda p: (-len(p[0]), p[0])))


_MARKS = r"[A-Za-z][\u0300-\u036f]+"


def compose(x: Column) -> Column:
    """Canonical composition of Latin letters with marks; texts without combining marks pass as they are."""
    table = F.create_map(*[F.lit(v) for a, b in _compose_table() for v in (a, b)])
    swap = lambda s: F.aggregate(F.array_distinct(F.regexp_extract_all(s, F.lit(_MARKS), F.lit(0))), s, lambda acc, m: F.replace(acc, m, F.coalesce(F.try_element_at(table, m), m)))
    return once(x, lambda s: F.when(s.rlike("[\u0300-\u036f]"), swap(s)).otherwise(s))


def once(x: Column, f) -> Column:
    """f of a value that is computed once, as the variable of a lambda, however often f looks at it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def same_length_fold(x: Column) -> Column:
    """Accents off, letter for letter, so that places stay where they are."""
    return F.translate(x, *_fold_table())


def squeeze(x: Column) -> Column:
    """White space (Unicode's) trimmed, and each run of it one blank."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalized(x: Column) -> Column:
    """Composed, lower case, white space squeezed; accents stay."""
    return F.lower(compose(squeeze(x)))


#: Fixed: the pictographic characters of Unicode's emoji data, as ranges.
_PICTOGRAPHS = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2605 2607-2612 2614-2685 2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E "
    "2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A "
    "1F23C-1F23F 1F249-1F3FA 1F400-1F53D 1F546-1F64F 1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD"
)
#: Emoji and their modifiers, flags, and characters without width.
_EMOJI = "[" + "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in (*_PICTOGRAPHS.split(), "1F3FB-1F3FF", "1F1E6-1F1FF", "200B-200D", "2060", "FEFF", "FE0E-FE0F")) + "]"


#: Few ranges that hold all of these, so that most texts are passed over at once.
_MAY_BE_EMOJI = "[\\u00A9\\u00AE\\u200B-\\u200D\\u203C\\u2049\\u2060\\u2122-\\u2BFF\\u3030-\\u303D\\u3297-\\u3299\\uFE0E-\\uFEFF\\x{1F000}-\\x{1FFFF}]"


def comparable(x: Column) -> Column:
    """The text by which captures are compared: normalized, without emoji and characters of no width."""
    return once(normalized(x), lambda n: F.when(n.rlike(_MAY_BE_EMOJI), squeeze(F.regexp_replace(n, _EMOJI, ""))).otherwise(n))


#: Combining marks, which folding deletes.
_COMBINING = "".join(map(chr, range(0x0300, 0x0370)))


def flat(x: Column) -> Column:
    """Lower case without accents and combining marks, in one pass; white space stays."""
    a, b = _fold_table()
    return F.translate(F.lower(x), a + _COMBINING, b)


def fold(x: Column) -> Column:
    """Lower case without accents; combining marks go; white space squeezed."""
    return flat(squeeze(x))


def compact(x: Column) -> Column:
    """Folded letters and digits alone."""
    return F.regexp_replace(flat(x), "[^a-z0-9]+", "")


def word_line(x: Column) -> Column:
    """The folded words with one blank before, between and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(flat(x), "[^a-z0-9]+", " ")), F.lit(" "))


def lexemes(x: Column) -> Column:
    return F.filter(F.split(flat(x), "[^a-z0-9]+"), lambda w: w != "")


def author_key(author_id: Column, name: Column) -> Column:
    named = normalized(name)
    return F.when(F.coalesce(author_id, F.lit("")) != "", F.concat(F.lit("id:"), author_id)).when(F.coalesce(named, F.lit("")) != "", F.concat(F.lit("name:"), named)).otherwise("")


def fingerprint(scope: Column, author: Column, text: Column) -> Column:
    """SHA-256 of scope, author and the first 500 code points of the comparable text; null without text."""
    body = F.substring(comparable(text), 1, 500)
    return once(body, lambda b: F.when(F.coalesce(b, F.lit("")) != "", F.sha2(F.concat_ws("\u001f", scope, F.coalesce(author, F.lit("")), b), 256)))


def snippet(text: Column, most: int = 120, masked: bool = False) -> Column:
    """The first line with something on it, at most so many code points, the last an ellipsis if it was cut; null without one. Contacts are masked before the cut."""
    first = F.get(F.filter(F.transform(F.split(text, "\n"), squeeze), lambda x: x != ""), F.lit(0))
    line = mask(first) if masked else first
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def repost_key(author: Column, text: Column) -> Column:
    """SHA-256 of author key and comparable text; null if either is empty."""
    body = F.substring(comparable(text), 1, 500)
    return F.when((F.coalesce(author, F.lit("")) != "") & (F.coalesce(body, F.lit("")) != ""), F.sha2(F.concat_ws("\u001f", author, body), 256))


def split_title(text: Column) -> Column:
    """(title, rest): the first line, joined by a middle dot with those after it until it has 40 code points, cut at 80; the rest with what was cut off."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("used"), F.lit(0).alias("last"))
    taken = F.aggregate(
        lines,
        start,
        lambda a, x: F.when(a["used"] == 0, F.struct(x.alias("t"), F.lit(1).alias("used"), F.lit(0).alias("last"))).when((F.length(a["t"]) < 40), F.struct(F.concat(a["t"], F.lit(" · "), x).alias("t"), (a["used"] + 1).alias("used"), (F.length(a["t"]) + 3).alias("last"))).otherwise(a),
    )
    tail = F.when(F.length(taken["t"]) > 80, F.substr(F.get(lines, taken["used"] - 1), 81 - taken["last"]))
    rest = F.concat(F.array_compact(F.array(tail)), F.slice(lines, taken["used"] + 1, F.greatest(F.size(lines), F.lit(1))))
    none = F.coalesce(F.size(lines), F.lit(0)) == 0
    return F.struct(F.when(none, "").otherwise(F.substring(taken["t"], 1, 80)).alias("title"), F.when(none, "").otherwise(F.array_join(F.filter(rest, lambda x: x != ""), "\n")).alias("rest"))


#: Fixed: what stands in for masked contacts, words for digits (folded), keywords before a phone number.
PHONE_MASK, EMAIL_MASK, LINK_MASK = "[SĐT ẩn]", "[email ẩn]", "[link ẩn]"
DIGIT_WORDS = {"0": ("khong",), "1": ("mot",), "2": ("hai",), "3": ("ba",), "4": ("bon", "tu"), "5": ("nam", "lam"), "6": ("sau",), "7": ("bay",), "8": ("tam",), "9": ("chin",)}
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
SHORT_LINK = r"(?i)(?<![\w@.-])(?:https?://)?(?:[a-z0-9-]+\.)*(?:zalo\.me)(?:/[^\s<]*)?"
KEYWORD_PHONE = r"(?i)(lh|liên hệ|lien he|sđt|sdt|zalo|call|hotline)([^A-Za-z0-9_]{0,6})(?<![0-9.,])[35789](?:[ .-]?[0-9]){8}(?![0-9])(?!\s*(?:đ|₫|vnd|k\b|tr|triệu|trieu|củ|m\b))"
TRAILING = r"(?<![0-9])(?<![0-9][ .-])(?<!\+)\+?(?:0|84)(?:[ .-]?[0-9]){5,}(?=…|\z)"
PHONE = r"(?<![0-9])(?:\+?84|0)(?:[ .-]?[0-9]){9}(?![0-9])"


def _digit(digits: str) -> str:
    """A token for one of the digits: a digit, the letter o between digits for 0, or a word."""
    words = "|".join(w for d in digits for w in DIGIT_WORDS[d])
    letter = "|(?<=[0-9])o(?=[0-9])" if "0" in digits else ""
    return f"(?:[{digits}]{letter}|(?<![a-z])(?:{words})(?![a-z]))"


_GAP = r"(?:[\u200B-\u200D\u2060\uFEFF]*[\s.\-_*/\\\\|,()+]){0,3}[\u200B-\u200D\u2060\uFEFF]*".replace("\\\\\\\\", "\\\\")
_ANY, _ZERO = _digit("0123456789"), _digit("0")
_MOBILE, _LANDLINE = f"{_digit('35789')}(?:{_GAP}{_ANY}){{8}}", f"{_digit('2')}(?:{_GAP}{_ANY}){{9}}"
SPOKEN_PHONE = f"\\+?(?:{_ZERO}{_GAP}(?:{_MOBILE}|{_LANDLINE})|{_digit('8')}{_GAP}{_digit('4')}{_GAP}(?:{_MOBILE}|{_LANDLINE}))"


def _digit_table() -> tuple[str, str]:
    """Digits of other scripts and their ASCII ones."""
    pairs = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, 0x10000) if unicodedata.category(chr(c)) == "Nd"}
    return "".join(pairs), "".join(pairs.values())


def replace_shown(original: Column, shadow: Column, pattern: str, mark: str) -> Column:
    """The original with the mark in every place where the shadow, of the same length, matches."""
    gaps, hits = F.transform(F.split(shadow, pattern, -1), F.length), F.transform(F.regexp_extract_all(shadow, F.lit(pattern), F.lit(0)), F.length)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    spans = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    cut = F.aggregate(spans, start, lambda a, s: F.struct((a["at"] + s["gap"] + s["hit"]).alias("at"), F.concat(a["done"], F.substr(original, a["at"] + 1, s["gap"]), F.lit(mark)).alias("done")))
    return F.when(shadow.rlike(pattern), F.concat(cut["done"], F.substr(original, cut["at"] + 1))).otherwise(original)


def mask(text: Column) -> Column:
    """Contacts replaced by marks: profile links, e-mail addresses, phone numbers (also spelled, in other digits, or with signs between), those after a keyword, and numbers that a cut left at the end."""
    out = F.regexp_replace(F.regexp_replace(text, SHORT_LINK, LINK_MASK), EMAIL, EMAIL_MASK)
    out = replace_shown(out, F.translate(same_length_fold(F.lower(out)), *_digit_table()), SPOKEN_PHONE, PHONE_MASK)
    out = F.regexp_replace(out, KEYWORD_PHONE, f"$1$2{PHONE_MASK}")
    return F.regexp_replace(out, TRAILING, PHONE_MASK)


def first_phone(text: Column) -> Column:
    """The first mobile number 0[35789] and eight digits, with 84 as 0; null if none."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda p: F.regexp_replace(F.regexp_replace(p, "[^0-9]", ""), "^84", "0"))
    return F.get(F.filter(plain, lambda p: p.rlike("^0[35789][0-9]{8}$")), F.lit(0))


def mask_phone(p: Column) -> Column:
    return F.when(F.length(p) < 6, p).otherwise(F.concat(F.substring(p, 1, 4), F.lit(" ••• "), F.substring(p, -2, 2)))


def pseudonym(salt: str, key: Column) -> Column:
    """Eight hex digits that stand for an author's key under a salt; null for none."""
    return F.when(key != "", F.substring(F.sha2(F.concat_ws("\u001f", F.lit(salt), key), 256), 1, 8))


def author_label(ref: Column) -> Column:
    return F.concat(F.lit("Member #"), ref)


def _short(x: Column) -> Column:
    """A number with at most one decimal, without a decimal nought."""
    return F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")


def compact_price(n: Column) -> Column:
    """Billions and small millions to one decimal, larger millions and thousands whole, halves up."""
    up = lambda x: F.floor(x + 0.5)
    tr = n / 1e6
    return F.when(n >= 1e9, F.concat(_short(up(n / 1e8) / 10), F.lit("B"))).when(n >= 1e6, F.concat(F.when(tr < 10, _short(up(tr * 10) / 10)).otherwise(up(tr).cast("string")), F.lit("M"))).otherwise(F.concat(up(n / 1e3).cast("string"), F.lit("k")))


def kilometres(n: Column) -> Column:
    return F.concat(F.replace(F.format_number(F.floor(n + 0.5), 0), F.lit(","), F.lit(".")), F.lit(" km"))


def deal_badge(pct: Column) -> Column:
    n = F.floor(F.abs(pct) + 0.5)
    return F.when(n == 0, "≈ avg").when(pct < 0, F.concat(F.lit("▼"), n.cast("string"), F.lit("% vs avg"))).when(pct > 0, F.concat(F.lit("▲"), n.cast("string"), F.lit("% vs avg")))


def csv_cell(x: Column) -> Column:
    """Quoted where needed; cells that a spreadsheet would compute get a quote mark first."""
    safe = F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)
    return F.coalesce(F.when(safe.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe), F.lit(""))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


#: Fixed: named references that feeds' texts are decoded by, and what stands for them.
NAMED = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("ndash", "-"), ("mdash", "-"), ("hellip", "..."), ("lsquo", "'"), ("rsquo", "'"), ("ldquo", '"'), ("rdquo", '"'), ("copy", "(c)"), ("reg", "(r)"), ("laquo", "<<"), ("raquo", ">>"))


def decode_references(x: Column) -> Column:
    """Numeric and the NAMED character references decoded, once; a numeric one that is no character becomes a blank."""

    def decoded(m: Column) -> Column:
        body = F.regexp_extract(m, "&#([xX]?[0-9a-fA-F]+);", 1)
        code = F.when(body.rlike("^[xX]"), F.conv(F.substring(body, 2, 20), 16, 10)).otherwise(F.when(body.rlike("^[0-9]+$"), body)).try_cast("bigint")
        ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # an ampersand is held back, so that it starts no other reference
        return F.when(ok & (code == 38), "\ue000").when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(" ")

    found = F.array_distinct(F.regexp_extract_all(x, F.lit("&#(?:[xX][0-9a-fA-F]+|[0-9]+);"), F.lit(0)))
    out = F.aggregate(found, x, lambda acc, m: F.replace(acc, m, decoded(m)))
    # one search for all names: no character stands for a part of a reference, so each spelling that is there can go in a pass of its own
    table = F.create_map(*[F.lit(v) for pair in NAMED for v in pair])
    named = "(?i)&(?:" + "|".join(name for name, _ in NAMED) + ");"

    def plain(s: Column) -> Column:
        held = F.array_distinct(F.regexp_extract_all(s, F.lit(named), F.lit(0)))
        return F.aggregate(held, s, lambda acc, m: F.replace(acc, m, F.try_element_at(table, F.lower(F.regexp_replace(m, "[&;]", "")))))

    return F.replace(F.regexp_replace(once(out, plain), "(?i)&amp;", "&"), F.lit("\ue000"), F.lit("&"))


def html_text(x: Column) -> Column:
    """Text of a feed's HTML: scripts, styles and comments go, ends of blocks end lines, references are decoded; of blank lines in a row one stays."""
    x = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<\s*br\s*/?>", "\n"), r"(?i)</\s*(?:p|div|li|h[1-6]|tr|blockquote|ul|ol)\s*>", "\n")
    lines = F.transform(F.split(decode_references(F.regexp_replace(x, "<[^>]*>", " ")), "\n"), lambda s: F.regexp_replace(F.regexp_replace(s, "[ \t\u00a0]+", " "), r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


#: Fixed cues of the original, in its order. A buyer's cue counts where it does not address buyers; of conditions the first that has a cue holds.
BUY = ("cần mua", "can mua", "tìm mua", "tim mua", "muốn mua", "muon mua", "hỏi mua", "hoi mua", "want to buy", "wtb", "thu mua")
NOT_BUY = ("ai (?:cần|can) mua", "ai (?:có|co) nhu (?:cầu|cau)", "(?:người|nguoi) mua", "(?:khách|khach) mua")
SELL = ("cần bán", "can ban", "thanh lý", "thanh ly", "bán gấp", "ban gap", "ra đi", "ra di", "cho e ban", "for sale", "wts", "bán", "ban")
CONDITIONS = (
    ("broken", ("hỏng", "hong", "lỗi", "loi", "broken", "xác", "xac", "cháy", "chay")),
    ("new", ("mới 100%", "moi 100%", "new 100%", "nguyên seal", "nguyen seal", "fullbox", "brand new", "mới tinh", "moi tinh")),
    ("like_new", ("9[0-9]%", "like new", "như mới", "nhu moi", r"mới 9\d%")),
    ("used", ("đã qua sử dụng", "da qua su dung", "cũ", "cu", "used", r"second\s?hand", "qua tay")),
)


def _bounds(pattern: str) -> tuple[str, str]:
    word = "[A-Za-z0-9_]"
    first = f"(?<!{word})" if pattern[0].isascii() and (pattern[0].isalnum() or pattern[0] in "(_") else f"(?<={word})"
    last = f"(?!{word})" if pattern[-1].isascii() and (pattern[-1].isalnum() or pattern[-1] in "_)") else f"(?={word})"
    return first, last


def ascii_bound(pattern: str) -> str:
    """The pattern between word boundaries that know ASCII letters only: beside another letter or sign, a word character must stand outside."""
    first, last = _bounds(pattern)
    return f"{first}(?:{pattern}){last}"


def _any(cues: tuple[str, ...]) -> str:
    """Any of the cues between its boundaries, which are looked at once for all cues that have the same."""
    groups: dict[tuple[str, str], list[str]] = {}
    for c in cues:
        groups.setdefault(_bounds(c), []).append(c)
    return "|".join(f"{first}(?:{'|'.join(held)}){last}" for (first, last), held in groups.items())


def blanked(x: Column, pattern: str) -> Column:
    """The text with blanks of the same length for what the pattern matches, in all places where it stands."""
    blank = lambda acc, m: F.replace(acc, m, F.repeat(F.lit(" "), F.length(m)))
    return once(x, lambda s: F.aggregate(F.array_distinct(F.regexp_extract_all(s, F.lit(pattern), F.lit(0))), s, blank))


def intent(text: Column) -> Column:
    """sell or buy by whose cue stands first; a bare "mua" is a weak buy; else other. With a confidence."""
    return intent_of(normalized(text))


def intent_of(low: Column) -> Column:
    """intent() of a text that is normalized."""
    made = lambda name, confidence: F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence"))
    place = lambda x, cues: F.regexp_instr(x, F.lit(_any(cues)))

    def read(p: Column) -> Column:
        buy, sell = p["buy"], p["sell"]
        return F.when((buy > 0) & ((sell == 0) | (buy < sell)), made("buy", 0.9)).when(sell > 0, made("sell", 0.9)).when(p["x"].rlike(ascii_bound("mua")), made("buy", 0.55)).otherwise(made("other", 0.5))

    placed = once(blanked(low, _any(NOT_BUY)), lambda x: F.struct(x.alias("x"), place(x, BUY).alias("buy"), place(x, SELL).alias("sell")))
    return once(placed, read)


def condition(text: Column) -> Column:
    """broken, new, like_new or used by the first of these that has a cue; else unknown."""
    return once(normalized(text), condition_of)


def condition_of(low: Column) -> Column:
    """condition() of a text that is normalized."""
    out = F
    for name, cues in CONDITIONS:
        out = out.when(low.rlike(_any(cues)), name)
    return out.otherwise("unknown")
