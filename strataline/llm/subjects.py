"""Subject areas of documents (problem 8).

A document treats a subject if enough of its own sentences do.  Own sentences are those
left once log excerpts, dumps, quotations and headings are taken out.  A sentence treats the
subject whose terms it holds, weighted by how sure a sign of the subject a term is and how
rare it is.  The share of a document's sentences, and so its length, decides; each subject's threshold is
calibrated on labelled documents that are held out of the fit.

The terms, of one to three words, are curated from labelled documents by their support and by how purely they stand
with one subject.  They are fitted twice: on the labelled documents, then on these and on
unlabelled ones that the first terms give exactly one subject, which brings in terms that stand
beside known ones.  Only the labelled documents of the fit are a sample, of at most about ``SAMPLE``
drawn by a hash of their ids; the second fit and scoring cover every document whole.  Sentences are taken
out once, in one pass over the corpus, and written.  Terms are matched by one automaton over all of them, built once a
worker.  Where the labels give no term, a short list of fixed terms takes the place of curated ones.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import layouts as L
from strataline.operators.parsing import Rules
from strataline.session import materialize, small

#: Labelled documents the terms are fitted on, at most (about).
SAMPLE = 30_000
#: Documents of the fit a term must stand in, and the share of these that must be of one subject.
SUPPORT, PURITY = 3, 0.75
#: Weight of a sentence's terms from which it treats a subject.
ENOUGH = 1.0
#: Threshold as stated, a quarter of the sentences: it holds unless the labels held out speak against it by more than CLEARLY in
#: their F score, and for subjects of fewer than FEW labels held out that of all subjects together does.
SHARE, CLEARLY, FEW = 0.25, 0.005, 50
#: One labelled document in so many is held out.
HELD_OUT = 5

# Terms by subject, for corpora without labels.
CORE = {
    "power": "suspend path, standby current, wakelock, charging curve, charger handshake, doze window, power rail, discharge rate, battery drain, fuel gauge",
    "memory": "slab usage, out-of-memory killer, page cache, low memory stall, reclaim thread, allocation spike, swap area, resident set, heap growth, leak candidate",
    "graphics": "vsync offset, shader cache, surface buffer, dropped frames, render thread, layer composition, frame pacing, refresh rate, screen tearing, draw call",
    "network": "captive portal, wi-fi roaming, throughput drop, packet loss, handshake retry, dns lookup, routing table, socket timeout, access point, tethering session",
    "telephony": "baseband restart, emergency call, voicemail flag, roaming agreement, sim slot, cell reselection, text message queue, signal strength, carrier profile, call setup",
    "storage": "bad block, write amplification, partition table, trim pass, inode table, file system check, mount point, journal replay, flash wear, disk full",
    "audio": "speaker protection, mixer thread, microphone gain, volume curve, headset jack, sample rate, playback underrun, ringtone, echo canceller, audio routing",
    "camera": "video stabilisation, lens shading, exposure bracket, shutter lag, image sensor, flash sync, preview stream, autofocus, white balance, burst capture",
    "security": "keystore entry, verified boot, certificate chain, permission grant, biometric template, policy denial, lock screen, password prompt, sandbox escape, attestation",
    "location": "position accuracy, location request, dead reckoning, cold start fix, satellite fix, almanac download, track log, compass drift, geofence, indoor positioning",
}

_word = re.compile(r"[^\W_]+(?:[-_'][^\W_]+)*").findall
_fence = re.compile(r"^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)", re.S | re.M).sub
_bullet = re.compile(r"\s*(?:[-*+•–]|\d+[.)])\s+").match
_quoted = re.compile(r"\s*(?:[>|]|#)").match
_object = re.compile(r"\s*[\[{]").match
_dumped = re.compile(r"\s*(?:at [\w.$]+\(|#\d\d pc |\.\.\. \d+ more|Caused by: |[0-9a-fA-F]{4,}: (?:[0-9a-fA-F]{2} ?){4,}|[\w.$]+(?:Exception|Error): |\[[\w.]+\]: \[|\w+=\S*\s*$)").match
_ends = re.compile(r"[.!?…:;][\"'”’)\]]*\s*$").search
_stops = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+").split


#: Layout rules by the head of a line, remembered by the worker.
_rules = Rules({})


def own_sentences(text: str) -> list[list[str]]:
    """Sentences of a document as lists of lower-case words, without log excerpts, dumps, quotations and headings.

    A line that doesn't end a sentence goes on in the next, unless that is an item of a list."""
    paragraphs: list[str] = []
    open_line = False
    for line in (_fence("", text) if "```" in text else text).replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if not line.strip():
            open_line = False
            continue
        rule = _rules[L.head(line)]
        if _quoted(line) or _object(line) or _dumped(line) or (rule >= 0 and L.extract(rule, line).kind != L.CONT):
            open_line = False
            continue
        item = _bullet(line)
        body = line[item.end() :] if item else line
        if open_line and not item:
            paragraphs[-1] += " " + body.strip()
        else:
            paragraphs.append(body.strip())
        open_line = not _ends(body)
    out = []
    for p in paragraphs:
        for s in _stops(p):
            w = _word(s.lower())
            if len(w) >= 2 and (len(w) > 2 or _ends(s)):
                out.append(w)
    return out


def terms_of(sentences: list[list[str]]) -> set[str]:
    """All terms of one to three words without numbers."""
    out = set()
    for w in sentences:
        w = [x if x[0].isalpha() else "" for x in w]
        out.update(w)
        out.update([f"{a} {b}" for a, b in zip(w, w[1:]) if a and b])
        out.update([f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:]) if a and b and c])
    out.discard("")
    return out


def clean_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, subject``, each once, in lower case without white space."""
    return (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_replace(F.lower("subject"), r"(?U)^\s+|\s+$", "").alias("subject"))
        .where("doc_id is not null and subject is not null and subject <> ''")
        .distinct()
    )


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their own sentences, one a line, in place of the text."""
    for b in batches:
        own = ["\n".join(map(" ".join, own_sentences(text))) for text in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.string())], ["doc_id", "own"])


def _split(own: str) -> list[list[str]]:
    return [s.split(" ") for s in own.split("\n")] if own else []


def _counted(documents: Iterator[tuple[list[list[str]], str]]) -> Iterator[pa.RecordBatch]:
    """Documents, given as sentences and subject, by term and subject; combined here, so that little is shuffled."""
    counts: defaultdict[str, Counter] = defaultdict(Counter)

    def flush():
        subjects = [s for s, c in counts.items() for _ in range(len(c))]
        terms = [t for c in counts.values() for t in c]
        n = [k for c in counts.values() for k in c.values()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(subjects, pa.string()), pa.array(n, pa.int64())], ["term", "subject", "n"])

    for sentences, subject in documents:
        counts[subject].update(terms_of(sentences))
        if sum(map(len, counts.values())) > 500_000:
            yield flush()
    yield flush()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _counted((_split(own), subject) for b in batches for own, subject in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))


def _sampled(df: DataFrame, n: int, sample: int) -> DataFrame:
    """About ``sample`` of the ``n`` rows of ``df``, by a hash of their ids."""
    keep = min(1_000_000, 1_000_000 * sample // max(n, 1))
    return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < keep)


def _guesser(shared):
    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[str]], str]]:
        auto = worker_terms(*shared.value)
        for b in batches:
            for own in b.column(0).to_pylist():
                treated = [s for s, x in shares(own, auto).items() if x >= SHARE]
                if len(treated) == 1:
                    yield _split(own), treated[0]

    return lambda batches: _counted(guessed(batches))


def curate(counts: DataFrame, total: int) -> dict[str, tuple[str, float]]:
    """Term -> (subject, weight) from ``counts(term, subject, n)`` of ``total`` documents."""
    best = (
        counts.groupBy("term", "subject")
        .agg(F.sum("n").alias("n"))
        .groupBy("term")
        .agg(F.sum("n").alias("all"), F.max(F.struct("n", "subject")).alias("top"))
        .select("term", "all", F.col("top.n").alias("n"), F.col("top.subject").alias("subject"))
        .where(f"n >= {SUPPORT} and n >= {PURITY} * all and subject <> 'none'")
    )
    found = materialize(best, "terms")
    # a term's own part says it already
    w = F.split("term", " ")
    inner = F.array(*[F.get(w, F.lit(k)) for k in range(3)], *[F.concat_ws(" ", F.get(w, F.lit(k)), F.get(w, F.lit(k + 1))) for k in range(2)])
    parts = found.select("term", F.explode(inner).alias("part")).where("part <> term")
    said = parts.join(found.select(F.col("term").alias("part")), "part", "left_semi").select("term")
    weights: dict[str, tuple[str, float]] = {}
    for r in found.join(said, "term", "left_anti").collect():  # the vocabulary, not the documents
        sure = (r["n"] + 1) / (r["all"] + 2)
        rare = math.log(1 + total / r["all"]) / math.log(1 + total)
        weights[r["term"]] = (r["subject"], 2 * sure * (0.5 + rare))
    return weights


def held_out(column: str = "doc_id") -> Column:
    """Whether a labelled document is kept for the thresholds."""
    return F.pmod(F.xxhash64(column, F.lit("held out")), F.lit(HELD_OUT)) == 0


def fit_terms(own: DataFrame, named: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[str, float]]:
    """Terms from at most about ``sample`` labelled documents of one subject and from all unlabelled ones that these give one
    subject; ``own(doc_id, own)`` has the documents' sentences, ``named(doc_id, subject)`` the labels."""
    kind = "term string, subject string, n bigint"
    per_doc = named.where(~held_out()).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("subject").alias("subject")).where("n = 1").select("doc_id", "subject")
    n, every = per_doc.count(), own.count()
    fixed = {term: (subject, 2.0) for subject, terms in CORE.items() for term in terms.split(", ")}
    if not n:
        return fixed
    told = materialize(own.join(small(_sampled(per_doc, n, sample)), "doc_id").select("own", "subject").mapInArrow(_told, kind), "told")
    total = max(min(n, sample), 2)
    shared = own.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, curate(told, total) or fixed))
    others = own.join(small(named.select("doc_id").distinct()), "doc_id", "left_anti").select("own")
    return curate(told.unionByName(others.mapInArrow(_guesser(shared), kind)), total + every) or fixed


def automaton(weights: dict[str, tuple[str, float]]):
    auto = ahocorasick.Automaton()
    for term, value in weights.items():
        auto.add_word(f" {term} ", value)
    auto.make_automaton()
    return auto if weights else None


_automata: dict[str, ahocorasick.Automaton] = {}


def worker_terms(key: str, weights: dict[str, tuple[str, float]]):
    """The automaton of these terms, built once a worker."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = automaton(weights)
    return _automata[key]


def shares(own: str, auto) -> dict[str, float]:
    """Share of a document's own sentences, one a line, that treat each subject."""
    if not own or auto is None:
        return {}
    treated: dict[str, int] = {}
    sentences = own.split("\n")
    for w in sentences:
        weight: dict[str, float] = {}
        for _, (subject, x) in auto.iter(f" {w} "):
            weight[subject] = weight.get(subject, 0.0) + x
        if weight:
            subject, x = max(weight.items(), key=_heaviest) if len(weight) > 1 else next(iter(weight.items()))
            if x >= ENOUGH:
                treated[subject] = treated.get(subject, 0) + 1
    return {s: k / len(sentences) for s, k in treated.items()}


def _heaviest(item: tuple[str, float]) -> tuple[float, str]:
    return item[1], item[0]


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = worker_terms(*shared.value)
        for b in batches:
            ids, subjects, values = [], [], []
            for doc, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, x in shares(own, auto).items():
                    ids.append(doc)
                    subjects.append(s)
                    values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(subjects, pa.string()), pa.array(values, pa.float64())], ["doc_id", "subject", "share"])

    return run


def _threshold(rows: list[tuple[float, int, int]], told: int) -> float:
    """The threshold nearest to the stated one among those between an eighth and three eighths that agree with the labels as well
    as any, from ``(share, labelled so, all)``; ``told`` is the number of labels."""
    tried = []
    for step in range(25, 76):
        at = step / 200
        yes, every = (sum(r[k] for r in rows if r[0] >= at) for k in (1, 2))
        tried.append((2 * yes / (every + told), at))
    best = max(tried)[0]
    return min((at for f, at in tried if f >= best - CLEARLY), key=lambda at: abs(at - SHARE))


def calibrate(scored: DataFrame, named: DataFrame) -> dict[str | None, float]:
    """Threshold of each subject, and under None that of all together, by the labelled documents that were held out."""
    kept = named.where(held_out())
    judged = scored.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    marked = judged.join(kept.withColumn("told", F.lit(1)), ["doc_id", "subject"], "left")
    rows = marked.groupBy("subject", F.round("share", 2).alias("at")).agg(F.count("told").alias("yes"), F.count("*").alias("every")).collect()  # at most 101 a subject
    told = {r.subject: r.n for r in kept.where("subject <> 'none'").groupBy("subject").agg(F.count("*").alias("n")).collect()}
    of = lambda subject: [(r["at"], r.yes, r.every) for r in rows if subject in (None, r.subject)]
    out: dict[str | None, float] = {None: _threshold(of(None), sum(told.values())) if told else SHARE}
    for subject, n in told.items():
        if n >= FEW:
            out[subject] = _threshold(of(subject), n)
    return out


def document_subjects(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, subject, share`` of every subject a document treats.

    Null, empty and blank texts and texts without own sentences have no subject; labels
    may be repeated, misspelt in case and white space, or null.  Without labels fixed terms and a
    quarter of the sentences decide.  Empty tables give no rows; extra columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    own = materialize(texts.mapInArrow(_owned, "doc_id bigint, own string"), "own")
    named = materialize(clean_labels(labels), "labels")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, fit_terms(own, named, sample)))
    scored = materialize(own.where("doc_id is not null").mapInArrow(_scorer(shared), "doc_id bigint, subject string, share double"), "shares")
    limits = calibrate(scored, named)
    limit = F.lit(limits.pop(None))
    for subject, at in limits.items():
        limit = F.when(F.col("subject") == subject, at).otherwise(limit)
    return scored.where(F.col("share") >= limit).groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
