"""Line layouts: shape signatures, the extraction rule of each, and what a line yields.

A *signature* is the head of a line with every run of letters collapsed to ``a``, of
digits to ``9`` and of white space to one blank, punctuation kept.  Signatures are few
where lines are many, so the question "which program wrote this?" is answered once per
signature (`resolve`) and only the one extraction rule found is run on the line
(`extract`).  A line whose rule does not fit is a continuation.

Everything here is plain Python over single strings; `strataline.operators.entries`
runs it over Arrow batches.
"""

from __future__ import annotations

import json
import re
from datetime import date
from typing import NamedTuple

# ---------------------------------------------------------------- fixed values
# Kinds of lines.
CONT, START, JUL, JOPEN, STOP, LEVELLED, FIELD, STAMP = range(8)
"""CONT continuation; START an entry complete in its first line; JUL first line of an
entry whose level stands on the next; JOPEN an opening brace of an entry whose fields
follow; STOP heading, duration or separator; LEVELLED ``LEVEL: text``; FIELD a ``"key": value``
line; STAMP not an entry but states a time (thread trace, end of a service dump)."""

LEVELS = ("VERBOSE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
#: Spelling (upper case) to index into LEVELS plus one; 0 means no level.
LEVEL_OF = {
    **dict.fromkeys(("V", "VERBOSE", "VERBO", "TRACE", "FINER", "FINEST"), 1),
    **dict.fromkeys(("D", "DEBUG", "FINE"), 2),
    **dict.fromkeys(("I", "INFO", "NOTICE", "NOTIC", "CONFIG"), 3),
    **dict.fromkeys(("W", "WARN", "WARNING", "WARNI"), 4),
    **dict.fromkeys(("E", "ERR", "ERROR", "SEVERE", "SEVER"), 5),
    **dict.fromkeys(("F", "FATAL", "CRIT", "CRITICAL", "ALERT", "EMERG", "PANIC"), 6),
}
#: Kernel priority digit to the same.
PRIORITY_LEVEL = {"0": 6, "1": 6, "2": 6, "3": 5, "4": 4, "5": 3, "6": 3, "7": 2}
MONTHS = {m: i for i, m in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1)}

#: How a time is stated.
NO_TIME, EPOCH, LOCAL, YEARLESS, BOOT = range(5)
# ----------------------------------------------------------------

HEAD, SIGNATURE = 48, 28
_CLASSES = bytearray(range(256))
for _c in range(256):
    if chr(_c).isascii() and (chr(_c).isalpha() or _c == 95) or _c >= 128:
        _CLASSES[_c] = 97
    elif 48 <= _c <= 57:
        _CLASSES[_c] = 57
    elif _c in (9, 10, 11, 12, 13, 28, 29, 30, 31):
        _CLASSES[_c] = 32
_CLASSES = bytes(_CLASSES)
#: Replacements that shorten any run of up to 4 * HEAD equal bytes to one: 8 to 1, 4 to 1, then halves.
_HALVINGS = [(c * n, c) for n in (8, 8, 4, 2, 2, 2) for c in (b"a", b"9", b" ")]


#: What counts as white space at the beginning of a line: the characters of that class.
_BLANKS = "".join(chr(c) for c in range(33) if _CLASSES[c] == 32)


def head(line: str) -> bytes:
    """Character classes of the head of a line, not yet collapsed but for white space before it, which may be
    of any length and would push the head out of the part that is looked at."""
    start = line[:HEAD]
    if start and start[0] in _BLANKS:
        start = " " + line.lstrip(_BLANKS)[: HEAD - 1]
    return start.encode("utf-8", "replace").translate(_CLASSES)


def collapse(classes: bytes) -> bytes:
    """Signature of a head."""
    for run, one in _HALVINGS:
        classes = classes.replace(run, one)
    return classes[:SIGNATURE]


def signature(line: str) -> bytes:
    """Collapsed character classes of the head of a line."""
    return collapse(head(line))


class Found(NamedTuple):
    """What one line states.  ``clock`` is NO_TIME, EPOCH, LOCAL, YEARLESS or BOOT; ``micros``
    counts from 1970 (EPOCH, LOCAL as if UTC, YEARLESS as if in 2000) or from boot, null if the fields
    are no date as written; ``swapped`` is the reading with day and month exchanged, in layouts whose
    order of the two isn't certain, where that is another date; ``offset`` is in
    seconds and ``abbr`` a zone's abbreviation, where the line states one."""

    kind: int
    level: int = 0
    component: str | None = None
    message: str | None = None
    clock: int = NO_TIME
    micros: int | None = None
    swapped: int | None = None
    offset: int | None = None
    abbr: str | None = None


_days: dict[tuple, int | None] = {}


def _day(y: str | int, m: str | int, d: str | int) -> int | None:
    """Days from 1970, None if there is no such date."""
    key = (y, m, d)
    if key not in _days:
        if len(_days) > 200_000:
            _days.clear()
        try:
            _days[key] = date(int(y), int(m), int(d)).toordinal() - 719163
        except ValueError:
            _days[key] = None
    return _days[key]


def _micros(day: int, h: str, mi: str, s: str, frac: str | None) -> int | None:
    hh, mm, ss = int(h), int(mi), int(s)
    if hh > 23 or mm > 59 or ss > 60:
        return None
    return ((day * 24 + hh) * 60 + mm) * 60_000_000 + ss * 1_000_000 + (int(frac[:6].ljust(6, "0")) if frac else 0)


def _stamp(y, m, d, h, mi, s, frac, swap: bool):
    """(micros, swapped), each None where it is no date; None if neither is."""
    day, other = _day(y, m, d), _day(y, d, m) if swap and m != d else None
    if day is None and other is None:
        return None
    a = _micros(day, h, mi, s, frac) if day is not None else None
    b = _micros(other, h, mi, s, frac) if other is not None else None
    return None if a is None and b is None else (a, b)


#: Longest numbers of seconds or of smaller units that are read; longer ones are no times.
_SECONDS_DIGITS, _EPOCH_DIGITS = 11, 20


def _offset(text: str) -> int:
    """+hh, +hhmm, +hh:mm or Z in seconds."""
    if text in ("Z", "z"):
        return 0
    x = text[1:].replace(":", "")
    return (-1 if text[0] == "-" else 1) * (int(x[:2]) * 3600 + int(x[2:4] or 0) * 60)


def _epoch(text: str) -> int | None:
    """Seconds, milli-, micro- or nanoseconds since 1970, told apart by their size; in microseconds."""
    whole, _, frac = text.partition(".")
    n = len(whole)
    if n > _EPOCH_DIGITS or not whole.isdecimal() or (frac and not frac.isdecimal()):
        return None
    if n <= 11:
        return int(whole) * 1_000_000 + (int(frac[:6].ljust(6, "0")) if frac else 0)
    if n <= 14:
        return int(whole) * 1000 + (int(frac[:3].ljust(3, "0")) if frac else 0)
    return int(whole) if n <= 17 else int(whole) // 1000


def _level(word: str) -> int:
    return LEVEL_OF.get(word.strip().upper(), 0)


_T = r"(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?"
_rx = re.compile
_thread = _rx(rf"(\d\d)-(\d\d) {_T} +(?:u\d+ +)?\d+ +\d+ +(?:\d+ +)?([VDIWEF]) (.*?):(?: (.*))?$", re.S).match
_zoned = _rx(rf"(\d{{4}})-(\d\d)-(\d\d) {_T} ([+-]\d\d:?\d\d|Z) +(?:u\d+ +)?\d+ +\d+ +(?:\d+ +)?([VDIWEF]) (.*?):(?: (.*))?$", re.S).match
_brief = _rx(r"([VDIWEF])/(.*?)\( *\d+\):(?: (.*))?$", re.S).match
_cpu = r"(?:\[\d+: *[^\]]*\] )?"
_kernel1 = _rx(rf"<(\d)>\[ *(\d+)\.(\d+)\] {_cpu}([^:]+):(?: (.*))?$", re.S).match
_kernel2 = _rx(rf"\w+ *:(\w+) *: \[ *(\d+)\.(\d+)\] {_cpu}([^:]+):(?: (.*))?$", re.S).match
_kernel3 = _rx(rf"\[ *(\d+)\.(\d+)\] {_cpu}<(\d)> ([^:]+):(?: (.*))?$", re.S).match
_syslog = _rx(rf"([A-Z][a-z]{{2}}) ( ?\d{{1,2}}) {_T} \S+ ([^\[]+?)\[\d+\]: <(\w+)>(?: (.*))?$", re.S).match
_piped = _rx(rf"(\d{{4}})-(\d\d)-(\d\d)[T ]{_T}([+-]\d\d:?\d\d|Z)? \| (\w+) *\| (.*?)\|(?: (.*))?$", re.S).match
_dated = _rx(rf"[A-Z][a-z]{{2}} ([A-Z][a-z]{{2}}) ( ?\d{{1,2}}) {_T} (\S+) (\d{{4}}) \[([^\]]+)\] (\w+) -(?: (.*))?$", re.S).match
_braced = _rx(rf"(?:\x1b\[[\d;]*m)?\[(\d\d)\.(\d\d)\.(\d{{4}}) {_T}\]\[(\w+) *\] \[([^\]]+)\](?: (.*))?$", re.S).match
_colour = _rx(r"\x1b\[[\d;]*m$").match
_classed = _rx(rf"([A-Z][a-z]{{2}}) (\d{{1,2}}), (\d{{4}}) (\d{{1,2}}):(\d\d):(\d\d) ([AP]M) (\S+) \S+\s*$").match
_levelled = _rx(r"([A-Z]+):(?: (.*))?$", re.S).match
_sourced = _rx(rf"([VDIWEF])(\d\d)(\d\d) {_T} +\d+ ([^:\]]+):\d+\](?: (.*))?$", re.S).match
_field = _rx(r'\s+"(\w+)": (.*)$', re.S).match
_pair = _rx(r'(?<!\w)(\w++)=("(?:\\.|[^"\\])*+"|\S*)').findall
_iso = _rx(rf"(\d{{4}})-(\d\d)-(\d\d)T{_T}(Z|[+-]\d\d:?\d\d)?$").match
_trace = _rx(rf"----- pid \d+ at (\d{{4}})-(\d\d)-(\d\d) {_T}([+-]\d\d:?\d\d|Z)?").match
_ending = _rx(rf"-{{9,}} .*ending at: (\d{{4}})-(\d\d)-(\d\d) {_T}\s*$").match
_json = json.JSONDecoder(parse_float=str, parse_int=str).decode
_surrogate = _rx("[\ud800-\udfff]").sub


def _thread_line(s):
    if not (m := _thread(s)):
        return None
    mo, d, h, mi, sec, fr, lv, tag, msg = m.groups()
    if not (t := _stamp(2000, mo, d, h, mi, sec, fr, True)):
        return None
    return Found(START, LEVEL_OF[lv], tag.strip(), msg, YEARLESS, *t)


def _zoned_line(s):
    if not (m := _zoned(s)):
        return None
    y, mo, d, h, mi, sec, fr, z, lv, tag, msg = m.groups()
    if not (t := _stamp(y, mo, d, h, mi, sec, fr, False)):
        return None
    return Found(START, LEVEL_OF[lv], tag.strip(), msg, LOCAL, t[0], None, _offset(z))


def _brief_line(s):
    if not (m := _brief(s)):
        return None
    return Found(START, LEVEL_OF[m[1]], m[2].strip(), m[3])


def _boot(sec, frac):
    """Clock and microseconds of seconds since boot; no time where they are beyond any clock."""
    if len(sec) > _SECONDS_DIGITS:
        return NO_TIME, None
    return BOOT, int(sec) * 1_000_000 + int(frac[:6].ljust(6, "0"))


def _kernel1_line(s):
    if not (m := _kernel1(s)) or m[1] not in PRIORITY_LEVEL:
        return None
    return Found(START, PRIORITY_LEVEL[m[1]], m[4].strip(), m[5], *_boot(m[2], m[3]))


def _kernel2_line(s):
    if not (m := _kernel2(s)) or not (lv := _level(m[1])):
        return None
    return Found(START, lv, m[4].strip(), m[5], *_boot(m[2], m[3]))


def _kernel3_line(s):
    if not (m := _kernel3(s)) or m[3] not in PRIORITY_LEVEL:
        return None
    return Found(START, PRIORITY_LEVEL[m[3]], m[4].strip(), m[5], *_boot(m[1], m[2]))


def _syslog_line(s):
    if not (m := _syslog(s)) or m[1] not in MONTHS or not (lv := _level(m[8])):
        return None
    if not (t := _stamp(2000, MONTHS[m[1]], m[2], m[3], m[4], m[5], m[6], False)):
        return None
    return Found(START, lv, m[7].strip(), m[9], YEARLESS, t[0])


def _piped_line(s):
    if not (m := _piped(s)) or not (lv := _level(m[9])):
        return None
    if not (t := _stamp(m[1], m[2], m[3], m[4], m[5], m[6], m[7], False)):
        return None
    return Found(START, lv, m[10].strip(), m[11], LOCAL, t[0], None, _offset(m[8]) if m[8] else None)


def _dated_line(s):
    if not (m := _dated(s)) or m[1] not in MONTHS or not (lv := _level(m[10])):
        return None
    if not (t := _stamp(m[8], MONTHS[m[1]], m[2], m[3], m[4], m[5], m[6], False)):
        return None
    zone = m[7]
    num = zone[0] in "+-" and zone[1:].replace(":", "").isdecimal()
    return Found(START, lv, m[9].strip(), m[11], LOCAL, t[0], None, _offset(zone) if num else None, None if num else zone)


def _braced_line(s):
    s = s.rstrip()
    if (k := s.rfind("\x1b[")) >= 0 and _colour(s, k):
        s = s[:k]
    if not (m := _braced(s)) or not (lv := _level(m[8])):
        return None
    if not (t := _stamp(m[3], m[2], m[1], m[4], m[5], m[6], m[7], True)):
        return None
    return Found(START, lv, m[9].strip(), m[10], LOCAL, *t)


def _classed_line(s):
    if not (m := _classed(s)) or m[1] not in MONTHS or not 1 <= int(m[4]) <= 12:
        return None
    hour = int(m[4]) % 12 + (12 if m[7] == "PM" else 0)
    if not (t := _stamp(m[3], MONTHS[m[1]], m[2], hour, m[5], m[6], None, False)):
        return None
    return Found(JUL, 0, m[8], None, LOCAL, t[0])


def _levelled_line(s):
    if not (m := _levelled(s)) or not (lv := _level(m[1])):
        return None
    return Found(LEVELLED, lv, None, m[2])


def _sourced_line(s):
    if not (m := _sourced(s)):
        return None
    if not (t := _stamp(2000, m[2], m[3], m[4], m[5], m[6], m[7], True)):
        return None
    return Found(START, LEVEL_OF[m[1]], m[8].strip(), m[9], YEARLESS, *t)


def _first(o: dict, *names):
    return next((o[n] for n in names if n in o), None)


def _plain(v) -> str | None:
    """Text of a value: text as it is (halves of surrogate pairs replaced), anything else as JSON."""
    if v is None:
        return None
    return _surrogate("\ufffd", v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))


def _json_line(s):
    try:
        o = _json(s.strip())
        if not isinstance(o, dict):
            return None
        component, message = _plain(_first(o, "tag", "component", "logger")), _plain(_first(o, "msg", "message"))
    except (ValueError, RecursionError):
        return None
    lv = _level(str(_first(o, "lvl", "level", "severity") or ""))
    if not lv:
        return None
    t = _epoch(str(_first(o, "ts", "time") or ""))
    return Found(START, lv, component, message, EPOCH if t is not None else NO_TIME, t)


def _pairs_line(s):
    o = {k: v[1:-1] if v[:1] == '"' else v for k, v in _pair(s)}
    lv = _level(_first(o, "level", "lvl", "severity") or "")
    if not lv or not ("msg" in o or "message" in o):
        return None
    out = Found(START, lv, _first(o, "component", "tag", "logger"), _first(o, "msg", "message"))
    if m := _iso(_first(o, "ts", "time") or ""):
        if t := _stamp(*m.groups()[:7], False):
            return out._replace(clock=LOCAL, micros=t[0], offset=_offset(m[8]) if m[8] else None)
    return out


def _open_line(s):
    return Found(JOPEN)


def _field_line(s):
    """A field of an entry whose object spans lines: its level, component, message or time."""
    if not (m := _field(s.rstrip())):
        return None
    k, v = m[1], m[2].removesuffix(",")
    text = v[1:-1] if v[:1] == '"' else v
    if k in ("lvl", "level", "severity"):
        return Found(FIELD, _level(text))
    if k in ("tag", "component", "logger"):
        return Found(FIELD, 0, text)
    if k in ("ts", "time") and (t := _epoch(v)) is not None:
        return Found(FIELD, clock=EPOCH, micros=t)
    return Found(FIELD, 0, None, text if k in ("msg", "message") else None)


def _stop_line(s):
    return Found(STOP)


def _trace_line(s):
    if not (m := _trace(s)) or not (t := _stamp(*m.groups()[:7], False)):
        return Found(STOP)
    return Found(STAMP, clock=LOCAL, micros=t[0], offset=_offset(m[8]) if m[8] else None)


def _ending_line(s):
    if not (m := _ending(s)) or not (t := _stamp(*m.groups()[:7], False)):
        return Found(STOP)
    return Found(STAMP, clock=LOCAL, micros=t[0])


#: Name, what a signature of the layout looks like, its extraction.  The first that fits resolves.
RULES = (
    ("thread", _rx(rb"9-9 9:9:9[.,]9 "), _thread_line),
    ("zoned", _rx(rb"9-9-9 9:9:9([.,]9)? ([+-]9|a)"), _zoned_line),
    ("brief", _rx(rb"a/[^(]*(\(|$)|a/.{20}"), _brief_line),
    ("kernel_priority", _rx(rb"<9>\["), _kernel1_line),
    ("kernel_facility", _rx(rb"a ?:a ?: ?\["), _kernel2_line),
    ("kernel_bare", _rx(rb"\[ ?9\.9\] "), _kernel3_line),
    ("syslog", _rx(rb"a 9 9:9:9"), _syslog_line),
    ("piped", _rx(rb"9-9-9[a ]9:9:9"), _piped_line),
    ("dated", _rx(rb"a a 9 9:9:9"), _dated_line),
    ("braced", _rx(rb"(\x1b\[[9;]*a)?\[9\.9\.9 9:9:9"), _braced_line),
    ("classed", _rx(rb"a 9, 9 9:9:9 a "), _classed_line),
    ("sourced", _rx(rb"a9 9:9:9"), _sourced_line),
    ("levelled", _rx(rb"a:( |$)"), _levelled_line),
    ("object", _rx(rb'\{ ?"'), _json_line),
    ("object_open", _rx(rb"\{ ?$"), _open_line),
    ("object_field", _rx(rb' "a": '), _field_line),
    ("pairs", _rx(rb"a=\S"), _pairs_line),
    ("trace", _rx(rb"----- a 9 a 9"), _trace_line),
    ("service_end", _rx(rb"-{9,} 9\.9a "), _ending_line),
    ("heading", _rx(rb"-{5,}|={20,}"), _stop_line),
)


def resolve(sig: bytes) -> int:
    """Number of the extraction rule of a signature, -1 for continuations."""
    return next((i for i, (_, shape, _f) in enumerate(RULES) if shape.match(sig)), -1)


_CONTINUATION = Found(CONT)


def extract(rule: int, line: str) -> Found:
    """Run the rule on the line; a line that doesn't fit its rule is a continuation."""
    if rule < 0:
        return _CONTINUATION
    return RULES[rule][2](line.rstrip("\r\n")) or _CONTINUATION


# ---------------------------------------------------------------- canonical messages
_varying = _rx(
    r"(?:(?<![^=(,:])-)?(?:0x[0-9a-f]+"  # 0x1f
    r"|\d+(?:[.:]\d+)+"  # 1.5, 22:15:04
    r"|(?<![0-9a-z])(?=[a-f]*\d)[0-9a-f]{2,}(?![0-9a-z])"  # 00ab31
    r"|(?<=[#@])[a-f]{4,}(?![0-9a-z])|(?<=id[=:#])[a-f]{4,}(?![0-9a-z])"  # fade, where it is said to be an id
    r"|\d+)"
).sub
_dump = _rx(r"\s*[0-9a-f]{4,}:(?: [0-9a-f]{2})+\s*$", re.I).match


#: Longest word that is remembered.
REMEMBERED = 64


class _Words(dict):
    """Canonical form of each word, worked out once per worker while it is remembered."""

    def __missing__(self, word: str) -> str:
        out = _varying("#", word.lower())
        if len(word) <= REMEMBERED:
            if len(self) > 500_000:
                self.clear()
            self[word] = out
        return out


_word = _Words().__getitem__


def canonical(text: str | None) -> str:
    """Message without what varies between repeats: numbers, hexadecimal ids, times of day,
    letter case and white space.  Bytes of a hex dump count as hexadecimal."""
    if not text:
        return ""
    if _dump(text):
        return "#dump"
    return "".join(map(_word, text.split()))
