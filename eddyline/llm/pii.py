"""Personal data: base patterns, and further candidates judged by boosted trees.

Only DataFrame functions run over the texts. A pattern goes over a text once: matches are
set between marks and the text is split there, so that lengths of the pieces, summed
block by block, give the spans in code points. Work is in proportion to a text's length
and its matches.

High-recall generators propose further spans, several a kind and overlapping ones too;
depth-two boosted trees score their format and context, and those over a calibrated
threshold are accepted. Trees are fitted on the driver to a fixed list of labelled phrases,
put through the same expressions, and become a literal that one expression walks; thresholds come from
forms of phrases that no tree was fitted on.

Base spans never change, and may overlap one another. Accepted candidates are taken by
their start: one that overlaps a base span adds nothing; of two that overlap the one with
the higher score stays (at a tie the earlier, then the longer) and is held against the next.

Defined cases: null or empty text has no spans; texts of any length are whole; repeated rows
get equal results; an empty table gives an empty result; columns other than doc_id and text
don't matter, whatever they are called.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, written so that no engine backtracks over a run: each starts where a run does, or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){15}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Enough digits for anything but an e-mail address or a secret.
DIGITS = r"[0-9][0-9 .()-]{5,}[0-9]"
#: What a text must have for a pattern to be tried at all: a character, or (in parentheses) a pattern.
NEEDS = {"email": "@", "ip": f"({DIGITS})", "card": f"({DIGITS})", "phone": "+"}
AT, DOT = r"(?:\(at\)|\[at\]|\{at\}| at )", r"(?:\(dot\)|\[dot\]|\{dot\}| dot |\.)"
#: High-recall generators of candidates: kind, pattern, what a text must have. Runs are taken whole, whatever their length.
GENERATORS = (
    ("email", rf"(?i)(?<!{LOCAL}){LOCAL}++ ?{AT} ?[A-Za-z0-9-]++(?: ?{DOT} ?[A-Za-z0-9-]++){{1,4}}", rf"((?i)[ (\[{{]at[ )\]}}] ?[A-Za-z0-9-]{{1,63}} ?{DOT} ?[A-Za-z0-9-])"),
    ("email", rf"(?<!{LOCAL}){LOCAL}++(?: {{1,2}}@ {{0,2}}|@ {{1,2}})[A-Za-z0-9-]++(?: {{0,2}}\. {{0,2}}[A-Za-z0-9-]++){{1,4}}", "@"),
    ("phone", r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])", f"({DIGITS})"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,5}\)[\x20-]?)?0?[0-9]{6,11}(?![0-9.-])", f"({DIGITS})"),
    ("phone", r"(?<![0-9+.-])(?:00)?[0-9]{1,4}(?:[\x20.-]\(?[0-9]{2,4}\)?){2,5}(?![0-9.-])", f"({DIGITS})"),
    ("card", r"(?<![0-9-])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9-])", f"({DIGITS})"),
    ("card", r"(?<![0-9-])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9-])", f"({DIGITS})"),
    ("id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}|[0-9]{9}|[A-Z]{1,2}[0-9]{6,8})(?![0-9A-Za-z-])", f"({DIGITS}|[0-9]{{6}})"),
    ("id", r"(?<![0-9A-Za-z.-])(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})(?![0-9A-Za-z-])", r"([0-9][./-][0-9]{1,2}[./-][0-9])"),
    ("id", r"(?<![0-9A-Za-z-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z-])", r"([A-Z]{2}[0-9]{2})"),
    ("secret", r"(?i)(?<![0-9A-Za-z_-])[0-9A-Za-z_-]*+(?<=token|secret|key|passwd|password|pwd|key_id|key-id)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[^\s\"',;]{6,}+", r"([:=]\s{0,3}[\"']?[^\s\"',;]{6})"),
    ("secret", r"(?i)(?<![0-9A-Za-z])(?:bearer|basic)\s{1,3}[0-9A-Za-z._~+/=-]{16,}+", r"((?i)(?:bearer|basic)\s)"),
    ("secret", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])", r"([0-9A-Fa-f]{32})"),
    ("secret", r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?:gh[pousr]|github_pat)_[0-9A-Za-z_]{20,}+|sk-[0-9A-Za-z_-]{20,}+|xox[abp]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+(?:\.[0-9A-Za-z_-]++)?+)", r"((?:AKIA|gh[pousr]_|github_pat_|sk-|xox[abp]-|AIza|eyJ)[0-9A-Za-z])"),
)
KINDS = ("email", "phone", "card", "id", "secret")
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b[^.]{0,20}$",
    "phone": r"(?i)\b(?:call|tel|telephone|phone|mobile|cell|fax|dial|ring|reach|contact|number|toll-free|whatsapp)\b[^.]{0,20}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay|paid|charged)\b[^.]{0,20}$",
    "id": r"(?i)\b(?:ssn|social security|iban|account|passport|tax id|born|birth|birthday|dob|licen[cs]e no)\b[^.]{0,20}$",
    "secret": r"(?i)\b(?:token|secret|key|passwd|password|pwd|credentials?|auth|authorization)\b[^.]{0,20}$",
}
AROUND = 40
ROUNDS, RATE = 30, 0.3
#: Scores are shifted so that at least this share of what is accepted on held-out forms is right.
PRECISION = 0.95
#: Elements whose results are gathered in one array before arrays are joined: two levels keep long ones cheap.
BLOCK = 256
#: Stands around matches. In the text itself it becomes another character that no pattern knows either.
MARK, OTHER = "\x01", "\x02"
_SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"
_CANDIDATE = "struct<start:int,end:int,score:double,kind:string,value:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folded(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], end: Callable[[Column], Column] | None, out: str) -> Column:
    """What step(state, item) -> (next state, array of results) gives for some items in their order, and end(state) after them, joined."""

    def blocks(all_: Column) -> Column:
        def inner(acc: Column, x: Column) -> Column:
            following, made = step(acc["state"], x)
            return F.struct(following.alias("state"), F.when(F.size(made) > 0, F.concat(acc["out"], made)).otherwise(acc["out"]).alias("out"))

        def outer(acc: Column, b: Column) -> Column:
            zero = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{out}>").alias("out"))
            own = F.aggregate(F.slice(all_, b * BLOCK + 1, BLOCK), zero, inner)
            return _let(own, lambda o: F.struct(o["state"].alias("state"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

        zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
        last = lambda a: F.flatten(F.concat(a["out"], F.array(end(a["state"]))) if end else a["out"])
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), zero, outer, last)

    none = F.array().cast(f"array<{out}>")
    return _let(items, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(none))


def _matches(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """Spans of a pattern's leftmost, non-overlapping matches, in code points, with up to AROUND characters before and after that belong to no other match."""
    clean = F.when(F.instr(text, MARK) > 0, F.translate(text, MARK, OTHER)).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["piece"])
        end = start + F.char_length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["piece"], F.lit(AROUND)).alias("before"), F.substring(x["next"], 1, AROUND).alias("after"))
        return end, F.array(span)

    def spans(p: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: F.struct(F.get(p, i - 1).alias("piece"), F.get(p, i).alias("value"), F.get(p, i + 1).alias("next")))
        return F.when(F.size(p) > 2, _folded(pairs, F.lit(0), step, None, _SPAN)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    wanted = F.rlike(text, F.lit(needs)) if needs[0] == "(" else F.instr(text, needs) > 0
    return F.when(wanted, _let(pieces, spans)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        def fits(part: Column) -> Column:
            part = F.regexp_replace(part, "^0+", "")
            return (F.length(part) <= 3) & (F.concat(F.lit("0"), F.substring(part, 1, 3)).cast("int") <= 255)

        return F.forall(F.split(value, r"\."), fits)
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def features(kind: str, value: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of a candidate, as whole numbers."""
    digits = _digits(value)
    n = F.length(digits)
    return [
        F.rlike(before, F.lit(CONTEXT[kind])).cast("int"),
        n,
        F.char_length(value),
        F.length(F.regexp_replace(value, r"[^\x20.-]", "")),
        F.rlike(value, F.lit(r"[\[({]")).cast("int"),
        F.rlike(value, F.lit(r"(?i)(?:\bdot\b|\.)\W{0,2}(?:com|org|net|edu|info|io|de|fr|es|uk)$")).cast("int"),
        F.rlike(before, F.lit(r"(?i)(?:\border|item|no|page|version|part|ref|invoice|chapter)\W{1,3}$")).cast("int"),
        F.rlike(after, F.lit(r"^[A-Za-z0-9]")).cast("int"),
        F.length(F.regexp_replace(value, r"[^A-Z]", "")),
        F.rlike(before, F.lit(r"[0-9][\x20.-]?$")).cast("int"),
        (n.between(12, 19) & F.when(n.between(12, 19), _luhn(digits)).otherwise(False)).cast("int"),
        F.rlike(value, F.lit(r"[0-9][A-Za-z]+[0-9]+[A-Za-z]+[0-9]")).cast("int"),
        F.rlike(value, F.lit(r"[:=]")).cast("int"),
        F.rlike(value, F.lit(r"^(?:-----BEGIN|eyJ|AIza|github_pat_)")).cast("int"),
        F.rlike(value, F.lit(r"[0-9]")).cast("int"),
    ]


def _luhn_number(digits: list[int]) -> str:
    """The digits and the one that makes them pass."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return "".join(map(str, digits)) + str(-total % 10)


def _forms(i: int) -> list[tuple[str, str, str, str, int]]:
    """Phrases in the i-th variation of each form: kind, before, value, after, whether it is personal."""
    names, hosts = ("jane.doe", "k_lee", "office", "m.santos"), ("example", "mail-host", "uni")
    n, h = names[i % 4], hosts[i % 3]
    d = [(i * 7919 + k * 104729) % 10 for k in range(24)]
    num, sep, mark = "".join(map(str, d)), " .-"[i % 3], " -"[i % 2]
    hexa = "".join("0123456789abcdef"[(i * 31 + k * k * 7 + k * 13) % 16] for k in range(40))
    mixed = "".join("aZ3kQ9xB7mR2vT5w"[(i * 5 + k * k * 3 + k) % 16] for k in range(24))
    good, bad = _luhn_number(d[:15]), num[:15] + str((int(_luhn_number(d[:15])[-1]) + 1 + i % 8) % 10)
    amex = _luhn_number([3, 7, *d[:12]])
    fours = lambda x: mark.join(x[k : k + 4] for k in range(0, len(x), 4))
    return [
        ("email", ("Please e-mail ", "Contact: ", "")[i % 3], f"{n}{(' (at) ', '[at]', ' {at} ')[i % 3]}{h}{(' (dot) ', '[dot]', '.')[i % 3]}{('com', 'org', 'net')[i % 3]}", (" for more.", "", ".")[i % 3], 1),
        ("email", ("mail to ", "write to ")[i % 2], f"{n} at {h} dot {('com', 'org')[i % 2]}", " soon", 1),
        ("email", ("ask ", "")[i % 2], f"{n} @ {h} . {('com', 'net')[i % 2]}", (" please", "")[i % 2], 1),
        ("email", ("reach me under ", "my address: ")[i % 2], f"{n}(at){h}.{('de', 'uk', 'fr')[i % 3]}", ("!", "")[i % 2], 1),
        ("email", ("we met ", "they look ", "it was ")[i % 3], f"{('them', 'noon', 'once')[i % 3]} at {('home', 'noon', 'sea')[i % 3]}.{('Then', 'We', 'It')[i % 3]}", " went", 0),
        ("email", "he stood ", f"here at {h} dot by", " dot", 0),
        ("email", ("sold ", "bought ")[i % 2], f"{num[:2]} @ {num[2:4]}.{num[4:6]}", (" each", "")[i % 2], 0),
        ("email", ("look ", "stay ")[i % 2], f"up at {('dawn', 'night')[i % 2]}.{('She', 'He')[i % 2]}", " said", 0),
        ("phone", ("call ", "Tel: ", "my phone is ", "fax ")[i % 4], f"{'(' * (i % 2)}{num[:3]}{')' * (i % 2)}{sep}{num[3:6]}{sep}{num[6:10]}", (" now", ".", "")[i % 3], 1),
        ("phone", ("dial ", "mobile ")[i % 2], f"0{num[:9 + i % 2]}", (" today", "")[i % 2], 1),
        ("phone", ("ring ", "cell: ")[i % 2], f"0{num[0]} {num[1:3]} {num[3:5]} {num[5:7]} {num[7:9]}", (".", "")[i % 2], 1),
        ("phone", ("telephone ", "phone no: ")[i % 2], f"{num[:3]}-{num[3:7]}", (" at night", "")[i % 2], 1),
        ("phone", ("order no. ", "version ", "part ", "page ")[i % 4], f"{num[:3]}{sep}{num[3:6]}{sep}{num[6:10]}", (" ships", "", ",")[i % 3], 0),
        ("phone", ("scored ", "about ", "from ", "sums of ")[i % 4], f"{num[:2]} {num[2:5]} {num[5:8]}", (" units", " in all", "a")[i % 3], 0),
        ("phone", ("in ", "a total of ", "id ")[i % 3], num[: 7 + i % 4], (" lines", "", " rows")[i % 3], 0),
        ("phone", ("of ", "on ")[i % 2], f"20{num[:2]}-{num[2:4]}-{num[4:6]}", (" it rained", "")[i % 2], 0),
        ("phone", ("my number is ", "reach us: ", "toll-free ")[i % 3], (f"1-{num[:3]}-{num[3:6]}-{num[6:10]}", f"{num[:3]}.{num[3:6]}.{num[6:10]}", f"0044 {num[:2]} {num[2:6]} {num[6:10]}")[i % 3], (".", "", " any time")[i % 3], 1),
        ("phone", ("rows ", "between ", "of ")[i % 3], f"{num[0]} {num[1:4]} {num[4:7]} {num[7:10]}", (" bytes", "", " items")[i % 3], 0),
        ("card", ("card ", "charged to ", "")[i % 3], f"{amex[:4]}{mark}{amex[4:10]}{mark}{amex[10:]}", (" expires", "")[i % 2], 1),
        ("card", ("my visa ", "paid with ")[i % 2], _luhn_number(d[:12]), (".", "")[i % 2], 1),
        ("card", ("credit card: ", "mastercard ")[i % 2], fours(good), ("", " ok")[i % 2], 1),
        ("card", ("amex ", "debit card ")[i % 2], amex, ("", ",")[i % 2], 1),
        ("card", ("row ", "from ", "the sum ")[i % 3], bad, (" and", "")[i % 2], 0),
        ("card", ("serial ", "about ")[i % 2], fours(bad), (" of", "")[i % 2], 0),
        ("card", ("id ", "between ")[i % 2], num[: 12 + i % 3], ("", " counts")[i % 2], 0),
        ("card", ("item ", "")[i % 2], f"{num[:4]}{mark}{num[4:10]}{mark}{bad[-5:]}", (" x", "")[i % 2], 0),
        ("id", ("SSN ", "social security: ", "")[i % 3], f"{num[:3]}-{num[3:5]}-{num[5:9]}", (".", " on file", "")[i % 3], 1),
        ("id", ("IBAN ", "account ", "")[i % 3], f"{('DE', 'FR', 'ES')[i % 3]}{num[:2]} {num[2:6]} {num[6:10]} {num[1:5]} {num[3:7]}", ("", ".")[i % 2], 1),
        ("id", ("to ", "pay into ")[i % 2], f"{('NL', 'GB')[i % 2]}{num[:2]}{('ABNA', 'WEST')[i % 2]}{num[2:6]}{num[6:10]}{num[3:5]}", (" please", "")[i % 2], 1),
        ("id", ("her tax id is ", "my ssn: ")[i % 2], f"{num[4:7]}-{num[1:3]}-{num[7:11]}", (",", "")[i % 2], 1),
        ("id", ("SSN: ", "social security no ", "her ssn is ")[i % 3], num[:9], (".", "", ",")[i % 3], 1),
        ("id", ("passport ", "passport no. ", "Passport: ")[i % 3], f"{('C', 'XK', 'P')[i % 3]}{num[: 6 + i % 3]}", ("", ".", " issued")[i % 3], 1),
        ("id", ("born ", "date of birth: ", "DOB ")[i % 3], (f"19{num[:2]}-0{1 + d[2] % 9}-1{num[3]}", f"1{num[3]}.0{1 + d[2] % 9}.19{num[:2]}", f"0{1 + d[2] % 9}/1{num[3]}/19{num[:2]}")[i // 3 % 3], (".", "", " in")[i % 3], 1),
        ("id", ("on ", "since ", "posted ", "")[i % 4], (f"20{num[:2]}-0{1 + d[2] % 9}-1{num[3]}", f"1{num[3]}.0{1 + d[2] % 9}.20{num[:2]}", f"0{1 + d[2] % 9}/1{num[3]}/19{num[:2]}")[i // 4 % 3], (".", " it", "")[i % 3], 0),
        ("id", ("the ", "about ", "row ", "model ")[i % 4], (num[:9], f"{('A', 'TX')[i % 2]}{num[:6]}")[i % 2], (" of", "", " sold")[i % 3], 0),
        ("id", ("item ", "ref ", "invoice ", "order ")[i % 4], f"{num[:3]}-{num[3:5]}-{num[5:9]}", (" blue", "")[i % 2], 0),
        ("id", ("part no. ", "chapter ")[i % 2], f"{num[2:5]}-{num[5:7]}-{num[7:11]}", (" was", "")[i % 2], 0),
        ("secret", ("", "set ", "the ")[i % 3], f"{('token', 'api_key', 'secret')[i % 3]} = {chr(34)}{hexa}", (chr(34), chr(34) + " here")[i % 2], 1),
        ("secret", ("with ", "")[i % 2], f"{('password', 'passwd', 'pwd')[i % 3]}: {mixed[: 9 + i % 9]}", (" then", "")[i % 2], 1),
        ("secret", ("export ", "", "env: ")[i % 3], f"{('aws_secret_access_key', 'DB_PASSWORD', 'github-token', 'AWS_ACCESS_KEY_ID')[i % 4]}{('=', ' = ', ': ')[i % 3]}{mixed[: 12 + i % 9]}", ("", " end")[i % 2], 1),
        ("secret", ("Authorization: ", "header ", "with ")[i % 3], f"{('Bearer', 'bearer', 'Basic')[i % 3]} {('eyJ', 'a1', 'Zm9')[i % 3]}{mixed}{num[:4]}", ("", ".")[i % 2], 1),
        ("secret", ("", "file: ")[i % 2], f"-----BEGIN {('RSA ', '', 'OPENSSH ', 'EC ')[i % 4]}PRIVATE KEY-----", ("", " MII")[i % 2], 1),
        ("secret", ("the ", "a ")[i % 2], f"basic {('understanding', 'introduction-to', 'characteristics')[i % 3]}{('-of-it', '.', '')[i % 3]}", (" was", "")[i % 2], 0),
        ("secret", ("use ", "found ")[i % 2], f"{('AKIA' + mixed[:16].upper(), 'ghp_' + mixed + mixed[:12], 'sk-' + mixed)[i % 3]}", (" now", "")[i % 2], 1),
        ("secret", ("token ", "auth ")[i % 2], hexa, ("", ".")[i % 2], 1),
        ("secret", ("the ", "a ", "")[i % 3], f"{('key', 'token', 'password')[i % 3]}: {('remember', 'another', 'whatever')[i % 3]}", (" it", " one")[i % 2], 0),
        ("secret", ("commit ", "md5 ", "checksum ")[i % 3], hexa[: (40, 32)[i % 2]], (" of", "")[i % 2], 0),
        ("secret", ("keep ", "")[i % 2], f"{('secret', 'key')[i % 2]} = {('nothing', 'unknown', 'default')[i % 3]}", (" yet", "")[i % 2], 0),
        ("secret", ("file ", "blob ", "sha ")[i % 3], hexa[:39] + "0", ("", " was")[i % 2], 0),
    ]


def _phrases() -> list[tuple[int, str, str, str, str, int]]:
    """All phrases, each with the number of its form among those of its kind and label."""
    out = []
    for i in range(60):
        seen: dict[tuple, int] = {}
        for row in _forms(i):
            own = (row[0], row[-1])
            seen[own] = seen.get(own, -1) + 1
            out.append((seen[own], *row))
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple]]:
    """Boosted depth-two trees for log loss: a base score and (feature, cut, (feature, cut, low, high), (same)) for each tree."""
    score = np.full(len(y), base := float(np.log(y.mean() / (1 - y.mean()))))
    trees = []

    def best(mask: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        found = (-1.0, 0, 0.0)
        for f in range(x.shape[1]):
            for c in np.unique(x[mask, f])[:-1]:
                left = mask & (x[:, f] <= c)
                right = mask & (x[:, f] > c)
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1)
                if gain > found[0] + 1e-12:
                    found = (gain, f, float(c))
        return found[1:]

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c = best(np.ones(len(y), bool), g, h)
        sides = []
        for side in (x[:, f] <= c, x[:, f] > c):
            f2, c2 = best(side, g, h)
            leaves = []
            for leaf in (side & (x[:, f2] <= c2), side & (x[:, f2] > c2)):
                value = RATE * float(g[leaf].sum() / (h[leaf].sum() + 1))
                score[leaf] += value
                leaves.append(round(value, 6))
            sides.append((f2, c2, *leaves))
        trees.append((f, c, *sides))
    return base, trees


def _score(model: tuple, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model[0])
    for f, c, low, high in model[1]:
        side = np.where(x[:, f] <= c, np.where(x[:, low[0]] <= low[1], low[2], low[3]), np.where(x[:, high[0]] <= high[1], high[2], high[3]))
        out += side
    return out


def threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The lowest score from which on at least PRECISION are right; between two scores."""
    order = np.argsort(-scores)
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= PRECISION) & (y[order] == 1))
    at = int(good[-1]) if len(good) else 0
    following = scores[order][at + 1] if at + 1 < len(y) else scores[order][at] - 1
    return float((scores[order][at] + following) / 2)


@functools.cache
def _models(application: str) -> dict[str, tuple]:
    """By kind: (base score, trees, threshold). The last form of each kind and label is held out for the threshold."""
    spark = SparkSession.getActiveSession()
    out, rows = {}, _phrases()
    for kind in KINDS:
        own = [r for r in rows if r[1] == kind]
        last = {y: max(r[0] for r in own if r[-1] == y) for y in (0, 1)}
        df = spark.createDataFrame(own, "form int, kind string, before string, value string, after string, y int")
        got = np.array([list(r) for r in df.select(*features(kind, F.col("value"), F.col("before"), F.col("after")), "y", "form").collect()], float)  # a fixed list
        x, y, form = got[:, :-2], got[:, -2], got[:, -1]
        held = form == np.where(y == 1, last[1], last[0])
        model = _fit(x[~held], y[~held])
        out[kind] = (*model, threshold(_score(model, x[held]), y[held]))
    return out


_TREES = "array<struct<f:int,c:double,f0:int,c0:double,l0:double,h0:double,f1:int,c1:double,l1:double,h1:double>>"


def score(model: tuple, x: Column) -> Column:
    """The model's score of an array of features: its trees are one literal, walked from the first to the last."""
    trees = F.from_json(F.lit(json.dumps([dict(zip(("f", "c", "f0", "c0", "l0", "h0", "f1", "c1", "l1", "h1"), (f, c, *low, *high), strict=True)) for f, c, low, high in model[1]])), _TREES)
    side = lambda t, k: F.when(F.get(x, t[f"f{k}"]) <= t[f"c{k}"], t[f"l{k}"]).otherwise(t[f"h{k}"])
    return F.aggregate(trees, F.lit(model[0]), lambda total, t: total + F.when(F.get(x, t["f"]) <= t["c"], side(t, 0)).otherwise(side(t, 1)))


def _accepted(text: Column, model: tuple, kind: str) -> Column:
    """What the generators of a kind propose and its trees take, with the score above the threshold."""
    proposed = F.concat(*(_matches(text, kind, pattern, needs) for own, pattern, needs in GENERATORS if own == kind))
    measured = F.transform(proposed, lambda s: F.struct(s.alias("s"), F.array(*features(kind, s["value"], s["before"], s["after"])).alias("x")))
    scored = F.transform(measured, lambda c: F.struct(c["s"]["start"].alias("start"), c["s"]["end"].alias("end"), (score(model, c["x"]) - model[2]).alias("score"), F.lit(kind).alias("kind"), c["s"]["value"].alias("value")))
    return F.filter(scored, lambda c: c["score"] > 0)


def _resolved(base: Column, candidates: Column) -> Column:
    """Candidates that overlap no base span and no better candidate: a sweep backwards for base spans that start later, and one forwards for the rest."""
    fixed = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("double").alias("score"), b["kind"].alias("kind"), b["value"].alias("value")))
    # By start; base spans first, then the longer.
    keyed = F.transform(F.concat(fixed, candidates), lambda c: F.struct(c["start"].alias("start"), c["score"].isNotNull().alias("added"), (-c["end"]).alias("end"), c.alias("c")))
    kind = f"struct<start:int,added:boolean,end:int,c:{_CANDIDATE}>"
    empty, none = F.array().cast(f"array<{_CANDIDATE}>"), F.lit(None).cast(_CANDIDATE)

    def clear(following: Column, x: Column) -> tuple[Column, Column]:
        kept = ~x["added"] | (-x["end"] <= following)
        return F.when(x["added"], following).otherwise(x["start"]), F.when(kept, F.array(x)).otherwise(F.array().cast(f"array<{kind}>"))

    def choose(s: Column, x: Column) -> tuple[Column, Column]:
        c, best = x["c"], s["best"]
        blocked = x["added"] & (c["start"] < s["base"])
        meets = F.coalesce(c["start"] < best["end"], F.lit(False))
        stays = blocked | (meets & (best["score"] >= c["score"]))
        own = F.when(stays, s).otherwise(F.struct(s["base"].alias("base"), c.alias("best")))
        following = F.when(x["added"], own).otherwise(F.struct(F.greatest(s["base"], c["end"]).alias("base"), best.alias("best")))
        return following, F.when(x["added"] & ~stays & ~meets & best.isNotNull(), F.array(best)).otherwise(empty)

    end = lambda s: F.when(s["best"].isNotNull(), F.array(s["best"])).otherwise(empty)
    backwards = _folded(F.reverse(F.sort_array(keyed)), F.lit(2**31 - 1), clear, None, kind)
    found = _folded(F.reverse(backwards), F.struct(F.lit(0).alias("base"), none.alias("best")), choose, end, _CANDIDATE)
    return F.when(F.size(candidates) > 0, found).otherwise(empty)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base (spans of the base patterns) and added (accepted candidates). Spans: kind, start, end, value."""
    spark = docs.sparkSession
    models = _models(spark.sparkContext.applicationId)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))

    def checked(kind: str, pattern: str) -> Column:
        return F.transform(F.filter(_matches(F.col("text"), kind, pattern, NEEDS[kind]), lambda s: _valid(kind, s["value"])), plain)

    out = out.withColumn("base", F.concat(*(checked(*x) for x in BASE.items())))
    out = out.withColumn("candidates", F.concat(*(_accepted(F.col("text"), models[kind], kind) for kind in KINDS)))
    return out.select("doc_id", "text", "base", F.transform(_resolved(F.col("base"), F.col("candidates")), plain).alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; of overlapping spans the earlier and longer."""
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.col("text").alias("rest"))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        kept = F.substring(s["rest"], F.lit(1), x["start"] - s["at"])
        following = F.struct((-x["end"]).alias("at"), F.substring(s["rest"], -x["end"] - s["at"] + 1, F.char_length(s["rest"])).alias("rest"))
        inside = x["start"] < s["at"]
        return F.when(inside, s).otherwise(following), F.when(inside, F.array().cast("array<string>")).otherwise(F.array(kept, F.concat(F.lit("["), x["kind"], F.lit("]"))))

    redacted = _folded(spans, state, step, lambda s: F.array(s["rest"]), "string")
    return find(docs).select("doc_id", F.when(F.size(F.concat("base", "added")) > 0, F.array_join(redacted, "")).otherwise(F.col("text")).alias("text"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_spans, personal (whether there is any)."""
    found = find(docs)

    def of(spans: Column, kind: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    n = [F.size(of(F.col("base"), kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    everything = F.concat(*(F.sort_array(of(F.concat("base", "added"), kind)) for kind in (*BASE, *(k for k in KINDS if k not in BASE))))
    total = F.size("base") + F.size("added")
    return found.select("doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(everything).alias("spans"), total.cast("long").alias("n_spans"), (total > 0).alias("personal"))
