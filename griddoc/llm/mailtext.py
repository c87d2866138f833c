"""The newly written text of e-mails.

Structure first: header blocks, lines that introduce quotations, quoted and forwarded text, closing formulas and signatures
are recognised line by line. Then content, sentence by sentence, figures apart: each distinct sentence has a SimHash of its
letter pairs; near-matches are retrieved through tables on pairs of fingerprint blocks and verified by edit distance.

* Boilerplate: a sentence whose near-matches stand in the signed part of other mails, as disclaimers do, at least as often as
  in the new part; and one that a sender ends many of their mails with.
* Inherited text: a sentence, figures included, that an earlier mail of someone who takes part in this conversation held; and
  RUN consecutive sentences that any earlier mail held in the same order, whether marked as a quotation or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from griddoc.session import checkpointed, small

#: Mails in whose signed part a sentence must stand to be boilerplate.
SIGNED = 2
#: The same for a sentence that one sender ends mails with, and the part of the sender's mails (one in so many).
BY_SENDER, SENDER_SHARE = 3, 3
#: Blocks of the fingerprint, two of which near-matches must share, bits in which they may differ, and edits per hundred letters after that.
BLOCKS, BITS, EDITS_PERCENT = 8, 12, 8
#: Consecutive sentences shared with an earlier mail of unknown people that make inherited text; fewer may agree by chance.
RUN = 3
_QUOTED = re.compile(r"^\s*[>|]")
_SEPARATOR = re.compile(r"^\s*-{2,}\s*(original message|forwarded message|forwarded by .*|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message transféré|mensaje original|mensaje reenviado)\s*-{2,}\s*$|^\s*begin forwarded message:?\s*$", re.I)
_RULE = re.compile(r"^\s*_{20,}\s*$|^\s*-{20,}\s*$")
_HEADER = re.compile(r"^\s*(from|to|cc|bcc|subject|date|sent|reply-to|von|an|betreff|gesendet|datum|de|à|a|objet|envoyé|para|asunto|enviado|fecha)\s*:\s*\S", re.I)
_DATED = re.compile(r"^\s*(date|sent|gesendet|datum|envoyé|enviado|fecha)\s*:", re.I)
_TO = re.compile(r"^\s*(to|an|à|para)\s*:", re.I)
_SAID = re.compile(r"(\b(wrote|writes|escribió|scrisse|skrev)|\bschrieb\b.{0,80}|a écrit)\s*:\s*$|<[^<>\s]+@[^<>\s]+>\s*/\s*[\d./\- :]+:\s*$", re.I)
_SAYS = re.compile(r"^\s*(on|am|le|el|den|il)\b.*\d.*$", re.I)
_DELIMITER = re.compile(r"^\s*(--\s?|-{3,19}|_{3,19}|={3,})\s*$")
_CLOSING = re.compile(
    r"^\s*(?:(?:with |my )?(?:very )?(?:kind|best|warm|kindest|warmest)(?: (?:regards|wishes))?|(?:best|kind) (?:regards|wishes)|regards|many thanks|thanks and regards|thanks|thank you|yours"
    r"(?: (?:sincerely|faithfully|truly))?|sincerely(?: yours)?|cheers|br|rgds|mit (?:freundlichen|besten|vielen) grüßen|mit freundlichem gruß|freundliche grüße|viele grüße|beste grüße|"
    r"(?:bien )?cordialement|(?:meilleures |sincères )?salutations|bien à vous|(?:un |muchos )?(?:cordial )?saludos?|atentamente|un cordial saludo)\s*[,.!]?\s*$",
    re.I,
)
_POSTSCRIPT = re.compile(r"^\s*(p\.?\s?p?\.?\s?s\b\.?|n\.?b\.)", re.I)
_DEVICE = re.compile(r"^\s*(sent (?:from|via|with|using) |get (?:the |outlook)|gesendet (?:von|mit)|von meinem .* gesendet|envoyé (?:de|depuis)|enviado desde)", re.I)
_CONTACT = re.compile(r"^\s*(?:tel|phone|mobile|mob|fax|t|m|f|e-?mail)\b[.:]?\s*[+\d(]|^\s*\+?[\d ()/\-]{7,}$|^\s*[\w.\-]+@[\w.\-]+\s*$|^\s*(?:www\.|https?://)\S+\s*$", re.I)


_WROTE = re.compile(r"(?:,\s*|\b(?:um|at|à|las)\s+[\d:h]+\s*(?:schrieb|,)?\s*|^)([^,<>\d:]{3,60}?)\s*(?:<[^<>]*>\s*)?(?:wrote|writes|schrieb|a écrit|escribió)\b", re.I)
_NAMED = re.compile(r"^\s*[>|\s]*(?:from|to|cc|von|an|de|à|a|para)\s*:\s*(.+)$", re.I)


def person(name: str) -> int | None:
    """A key of a name or address in any writing; None for neither."""
    bare = re.sub(r"<[^<>]*>|[\"'()]", " ", name)
    words = sorted(re.findall(r"[^\W\d_]+", (bare if bare.strip() else name).lower()))
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63) if words and len(words) <= 6 else None


def _names(listed: str) -> list[str]:
    """The names of a list; a comma parts names only if there is more than one word, or an address, on each of its sides."""
    out = []
    for x in listed.split(";"):
        each = x.split(",")
        out += each if all("@" in y or len(y.split()) > 1 for y in each) else [x]
    return out


def parts(text: str) -> tuple[list[tuple[int, int]], list[int], int | None, set[int]]:
    """Lines as the structure shows them: (line index, paragraph) of those newly written, indices of those of the signed part
    (signature, disclaimers), the sender, and all who take part in the conversation as far as names show it."""
    lines = text.split("\n")
    n = len(lines)
    out: list[tuple[int, int]] = []
    signed: list[int] = []
    sender: int | None = None
    people: set[int] = set()
    mode, paragraph, header_seen, k = "new", 0, False, 0
    while k < n:
        line = lines[k]
        bare = line.strip()
        if not bare:
            paragraph += 1
            if mode in ("postscript", "device"):
                mode = "signed"
            k += 1
            continue
        if _QUOTED.match(line):
            paragraph += 1
            k += 1
            continue
        following = next((x for x in lines[k + 1 :] if x.strip()), "")
        if _SEPARATOR.match(line) or _RULE.match(line) and _HEADER.match(following):
            break
        if _HEADER.match(line):
            end = k
            while end < n and _HEADER.match(lines[end]):
                end += 1
            block = lines[k:end]
            if len(block) >= 2 or re.match(r"^\s*(from|von|de)\s*:", line, re.I) and end - k >= 1:
                own = not header_seen and any(map(_TO.match, block)) and not any(map(_DATED.match, block))
                if not own:
                    break
                sender = next((person(x.split(":", 1)[1]) for x in block if re.match(r"^\s*(from|von|de)\s*:", x, re.I)), None)
                header_seen, mode, k = True, "new", end
                paragraph += 1
                continue
        said = k if _SAID.search(line) else k + 1 if k + 1 < n and _SAYS.match(line) and _SAID.search(lines[k + 1]) and not _QUOTED.match(lines[k + 1]) else None
        if said is not None and (_SAYS.match(line) or len(bare) < 110):
            after = next((x for x in lines[said + 1 :] if x.strip()), "")
            if after and not _QUOTED.match(after):
                break
            paragraph += 1
            k = said + 1
            continue
        if _DELIMITER.match(line):
            mode = "signed"
        elif _CLOSING.match(line) and mode != "signed":
            mode = "signed"
            sender = person(following) if sender is None and len(following.split()) <= 4 else sender
        elif _DEVICE.match(line):
            mode = "signed" if mode != "new" or not any(x.strip() for x in lines[k + 1 :]) else "device"
        elif mode in ("new", "postscript", "signed") and _POSTSCRIPT.match(line):
            mode = "postscript"
            out.append((k, paragraph))
        elif mode in ("new", "postscript"):
            out.append((k, paragraph))
        elif mode == "signed" and not _CLOSING.match(line):
            signed.append(k)
        k += 1
    # A last paragraph of short lines with a telephone number or address is a signature without closing formula.
    if out:
        last = [i for i, p in out if p == out[-1][1]]
        if any(_CONTACT.match(lines[i]) for i in last) and all(len(lines[i].strip()) < 50 and lines[i].strip()[-1] not in ".!?:;," for i in last):
            out = [(i, p) for i, p in out if i not in last]
    for k, line in enumerate(lines):
        if m := _NAMED.match(line):
            people |= {person(x) for x in _names(m[1])}
        elif ":" in line and (m := _WROTE.search(line if _SAYS.match(line.lstrip("> |")) or not k else lines[k - 1].lstrip("> |") + " " + line.lstrip("> |"))):
            people.add(person(m[1]))
    people |= {sender}
    people.discard(None)
    return out, signed, sender, people


def _cut(lines: list[str], numbered: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(first line, last line, letters and figures) of each sentence or lone line of numbered lines; lines from 1.

    A line that only addresses someone, a list entry and a line after a finished one each begin a sentence of their own.
    """
    groups: list[list[int]] = []
    before = None
    for i, p in numbered:
        bare = lines[i].strip()
        apart = before is None or p != before[1] or i != before[0] + 1 or re.match(r"^\s*(?:[-*•]|\d+[.)])\s", lines[i]) or groups and len(groups[-1]) == 1 and lines[groups[-1][0]].rstrip().endswith(",") and len(lines[groups[-1][0]]) < 40 and bare[:1].isupper()
        if apart:
            groups.append([])
        groups[-1].append(i)
        before = (i, p)
    out = []
    for g in groups:
        start, words = g[0], []
        for i in g:
            for part in re.split(r"(?<=[.!?])\s+", lines[i].strip()):
                if not words:
                    start = i
                words.append(part)
                if part and part[-1] in ".!?":
                    out.append((start + 1, i + 1, " ".join(words)))
                    words = []
        if words:
            out.append((start + 1, g[-1] + 1, " ".join(words)))
    return [(a, b, " ".join(re.findall(r"[^\W_]+", s.lower()))) for a, b, s in out]


def _signed(lines: list[str], indices: list[int]) -> list[str]:
    """The sentences of the signed part; each of its lines begins one unless the line before fills it and leaves a sentence open."""
    paragraph, numbered = 0, []
    for i in indices:
        if numbered and (i != numbered[-1][0] + 1 or lines[i - 1].rstrip()[-1:] in ".!?" or len(lines[i - 1]) < 45):
            paragraph += 1
        numbered.append((i, paragraph))
    return [s for _, _, s in _cut(lines, numbered)]


def sentences(text: str) -> tuple[list[tuple[int, int, str]], list[str], int | None, set[int]]:
    """The new sentences of a mail, as _cut gives them, those of its signed part, the sender and the people of the conversation."""
    lines = text.split("\n")
    new, signed, sender, people = parts(text)
    return _cut(lines, new), _signed(lines, signed), sender, people


_MAIL = "coalesce(regexp_replace(lower(doc_type), '[^a-z]', '') in ('rawemail', 'email'), false) or coalesce(lower(file_name) rlike '[.](eml|msg)$', false)"
_UNIT = "seg_id long, file_name string, at long, pos int, left int, first int, last int, words string, figures long, sender long, people array<long>, run long"


def _masked(words: str) -> tuple[str, int]:
    """The sentence with figures masked, and a key of the figures."""
    return re.sub(r"\d+", "0", words), xxhash.xxh64_intdigest(" ".join(re.findall(r"\d+", words))) - (1 << 63)


def units(rows: DataFrame) -> DataFrame:
    """The sentences of every mail among rows, as _UNIT says.

    first is null for sentences of the signed part. left counts from the end, from 1. words has its figures masked, figures is
    their key. run is a key of the RUN new sentences of three words or more that begin with this one.
    """
    fields = T.StructType.fromDDL(_UNIT)
    schema = pa.schema([pa.field(f.name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(f.dataType.simpleString().replace("bigint", "long"), pa.list_(pa.int64()))) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, f, at, t in zip(*(c.to_pylist() for c in b.columns)):
                new, signed, sender, people = sentences(t)
                found = [(a, z, *_masked(w)) for a, z, w in new]
                keys = [xxhash.xxh64_intdigest(w + str(g)) if w.count(" ") >= 2 else None for _, _, w, g in found]
                for k, s in enumerate(found):
                    following = keys[k : k + RUN]
                    key = hash((RUN, *following)) if len(following) == RUN and None not in following else None
                    out.append((i, f, at, k, len(found) - k, *s, sender, sorted(people), key))
                out += [(i, f, at, None, None, None, None, *_masked(w), sender, None, None) for w in signed]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), x.type) for c, x in zip(zip(*out), schema)], schema=schema)

    at = F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(0)).alias("at")
    mails = rows.where(_MAIL).where(F.trim("text") != "").select(F.col("seg_id").cast("long"), F.coalesce("file_name", F.concat(F.lit("\x00"), F.col("seg_id").cast("string"))), at, "text")
    return mails.mapInArrow(run, _UNIT)


#: Letter pairs are hashed to so many features; each has a direction of 64 signs. Texts whose features are counted at once.
FEATURES, TOGETHER = 2048, 50
_SIGNS = np.where(np.random.default_rng(17).random((FEATURES, 64)) < 0.5, -1, 1).astype(np.int16)


def simhash(texts: list[str]) -> np.ndarray:
    """64-bit SimHash over the pairs of neighbouring letters of each text."""
    out = np.zeros(len(texts), np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for start in range(0, len(texts), TOGETHER):
        some = [f" {t} " for t in texts[start : start + TOGETHER]]
        code = np.frombuffer("".join(some).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in some])
        pair = (code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        feature = (pair >> np.uint64(40)).astype(np.int64) % FEATURES
        # The pair across the end of a text, the last of its pairs, is left out.
        last = np.cumsum(sizes) - 1
        signs = _SIGNS[np.append(feature, 0)]
        signs[last] = 0
        total = np.add.reduceat(signs, last - sizes + 1, axis=0, dtype=np.int32)
        signs = total > 0
        out[start : start + len(some)] = (signs * weight).sum(1, dtype=np.uint64)
    return out.view(np.int64)


@F.pandas_udf(T.LongType())
def _simhash(words: pd.Series) -> pd.Series:
    return pd.Series(simhash(words.tolist()) if len(words) else [], dtype="int64")


def _tables(rows: DataFrame) -> DataFrame:
    """rows with a column key for each pair of the BLOCKS blocks of their fingerprint f: each row once per table."""
    ends = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    block = [F.shiftrightunsigned("f", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(ends, ends[1:])]
    keys = [F.shiftleft(F.shiftleft(block[i], 11).bitwiseOR(block[j]), 8).bitwiseOR(F.lit(i * BLOCKS + j).cast("long")) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    return rows.withColumn("key", F.explode(F.array(*keys)))


def near(asked: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """(the columns by, id, other): for each sentence of asked (by, id, words) its near-matches of held (by, other, words) under equal by.

    Fingerprints that differ in few bits mostly agree in two whole blocks of BLOCKS, so a near-match stands under a common key
    in one of the tables; it is verified by its edit distance. The sentence itself is a near-match.
    """
    a = _tables(asked.select(*by, "id", _simhash("words").alias("f"))).withColumnRenamed("f", "fa")
    b = _tables(held.select(*by, "other", _simhash("words").alias("f"))).withColumnRenamed("f", "fb")
    pairs = a.join(b, [*by, "key"]).where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= BITS).select(*by, "id", "other").distinct()
    mine, its = asked.select(*by, "id", "words"), held.select(*by, "other", F.col("words").alias("its"))
    edits = F.levenshtein("words", "its")
    alike = edits * 100 <= EDITS_PERCENT * F.greatest(F.length("words"), F.length("its"))
    return pairs.join(mine, [*by, "id"]).join(its, [*by, "other"]).where(alike).select(*by, "id", "other")


def boilerplate(u: DataFrame) -> DataFrame:
    """id of the sentences among units that are boilerplate of the corpus.

    Each mail file counts once. What stands in the signed part is known for certain; a new sentence is boilerplate if it or a
    near-match stands there in SIGNED mails or more, and in as many as it stands elsewhere.
    """
    each = u.select("id", "words", "file_name", F.col("first").isNull().alias("signed")).distinct()
    counts = each.groupBy("id").agg(F.first("words").alias("words"), F.count_if("signed").alias("s"), F.count_if(~F.col("signed")).alias("n"))
    counts = checkpointed(counts)
    held = counts.where(F.col("s") >= SIGNED).select(F.col("id").alias("other"), "words", F.col("s").alias("held"))
    asked = counts.where("n > 0").select("id", "words", "n")
    found = near(asked.select("id", "words"), small(checkpointed(held)), []).join(held.select("other", "held"), "other").join(asked.select("id", "n"), "id")
    return found.where(F.col("held") >= F.col("n")).select("id").distinct()


def by_sender(u: DataFrame) -> DataFrame:
    """(origin, id, figures) of the sentences that a sender, or who writes files of one name but for figures, ends mails with: BY_SENDER mails or more, one in SENDER_SHARE of them, nine times in ten near the end."""
    mine = u.where("first is not null")
    mails = mine.groupBy("origin").agg(F.count_distinct("file_name").alias("mails")).where(F.col("mails") >= BY_SENDER)
    each = mine.groupBy("origin", "id", "figures", "file_name").agg(F.min("left").alias("left"))
    often = each.groupBy("origin", "id", "figures").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("left") <= 2).alias("late")).where((F.col("n") >= BY_SENDER) & (F.col("late") * 10 >= F.col("n") * 9))
    return often.join(mails, "origin").where(F.col("n") * SENDER_SHARE >= F.col("mails")).select("origin", "id", "figures")


def inherited(u: DataFrame) -> DataFrame:
    """(seg_id, pos) of the new sentences among units that an earlier mail of the conversation held, or an earlier mail in a run.

    Mails of one file_name are one mail. Only people with mails in several files are looked up, and for each of their
    sentences only its earliest mail counts.
    """
    new = u.where("first is not null")
    said = new.where("sender is not null").select(F.col("sender").alias("person"), "figures", F.col("id").alias("other"), "words", "at", "file_name")
    asks = new.select(F.explode("people").alias("person"), "figures", "id", "words", "at", "file_name", "seg_id", "pos")
    files = asks.groupBy("person").agg(F.min("file_name").alias("lo"), F.max("file_name").alias("hi")).where("lo <> hi").select("person")
    files = small(checkpointed(files.join(said.select("person").distinct(), "person", "left_semi")))
    asks = checkpointed(asks.join(files, "person", "left_semi"))
    held = said.join(files, "person", "left_semi").groupBy("person", "figures", "other").agg(F.min(F.struct("at", "file_name")).alias("o"), F.first("words").alias("words"))
    held = checkpointed(held)
    by = ["person", "figures"]
    pairs = near(asks.select(*by, "id", "words").distinct(), held.select(*by, "other", "words"), by)
    first = pairs.join(held.select(*by, "other", "o"), [*by, "other"])
    alone = asks.join(first, [*by, "id"]).where((F.col("o.at") < F.col("at")) & (F.col("o.file_name") != F.col("file_name"))).select("seg_id", "pos")
    runs = new.where("run is not null").select("seg_id", "file_name", "at", "pos", "run")
    begun = runs.groupBy("run").agg(F.min(F.struct("at", "file_name")).alias("o"), F.min("file_name").alias("lo"), F.max("file_name").alias("hi")).where("lo <> hi").select("run", "o")
    late = runs.join(small(checkpointed(begun)), "run").where((F.col("o.file_name") != F.col("file_name")) & (F.col("o.at") < F.col("at")))
    long = new.where(F.size(F.split("words", " ")) >= 3).select("seg_id", "pos")
    in_runs = late.select("seg_id", F.explode(F.sequence("pos", F.col("pos") + RUN - 1)).alias("pos"))
    return alone.unionByName(in_runs).distinct().join(long, ["seg_id", "pos"], "left_semi")


def written(rows: DataFrame) -> DataFrame:
    """(seg_id, line_no) of every non-blank line newly written by the sender of the mails among rows.

    Null, empty and blank texts have no row; a second delivery of a mail (the same file_name) inherits nothing from the
    first; rows that are no mails are left out; other columns are ignored.
    """
    every = checkpointed(units(rows).withColumn("id", F.xxhash64("words")).withColumn("origin", F.coalesce("sender", F.xxhash64(F.regexp_replace("file_name", "[0-9]+", "0")))))
    u = every.where(F.size(F.split("words", " ")) >= 3)
    boiler = small(checkpointed(boilerplate(u)))
    own = small(checkpointed(by_sender(u)))
    taken = small(checkpointed(inherited(u)))
    new = every.where("first is not null").join(boiler, "id", "left_anti").join(own, ["origin", "id", "figures"], "left_anti").join(taken, ["seg_id", "pos"], "left_anti")
    return new.select("seg_id", F.explode(F.sequence("first", "last")).alias("line_no")).distinct()
