import random

from griddoc.llm import mailtext as k

MAILS = {
    "plain": ("Dear Ann,\n\nThe pump is\nrepaired.\n\nBest regards,\nBob\nTel. +00 123456\n\nIf you are not the intended recipient, please delete this mail.", {1, 3, 4}),
    "own header": ("From: Bob <b@x.example>\nTo: Ann\nSubject: Re: Oil\n\nFrom the drawing it follows: all is well.\n\nBR\nBob", {5}),
    "outlook": ("Hi all,\n\nDone.\n\n-----Original Message-----\nFrom: Ann\nHello Bob,\n\nPlease do.\n\nRegards,\nAnn", {1, 3}),
    "dated header": ("Fine.\n\nFrom: Ann\nDate: 2024-01-01 10:00\nSubject: Oil\nIs it fine?", {1}),
    "interleaved": ("Ann wrote:\n> One?\nYes, one.\n> Two?\nNo, two.\n\n-- \nBob", {3, 5}),
    "two-line attribution": ("Ok.\n\nOn Feb 5, 2025, at 15:07, Ann Lee\n<a@x.example> wrote:\n> really?", {1}),
    "german": ("Gut.\n\nAm 19.02.2024 um 22:41 schrieb Ann Lee:\n> Wie?", {1}),
    "french": ("Le 23/01/2025 à 17:28, Ann Lee a écrit :\n>> Quoi?\n\nBien reçu.", {4}),
    "slashed": ("Ann Lee <a@x.example> / 18.9.2024 23:52:\n> x\n\nNew.", {4}),
    "postscript": ("Text.\n\nKind regards\nBob\n\nP.S. More\ntext.\n\nOn 1 May 2024 at 10:00, Ann <a@x.example> wrote:\n> q", {1, 6, 7}),
    "forward only": ("---- Forwarded message ----\nDear all,\n\nText.", set()),
    "rule and header": ("New.\n________________________________\nFrom: Ann\nSent: 1 May\nTo: x\nSubject: y\nOld.", {1}),
    "device": ("New.\n\nSent from my phone\n\nE-mail traffic may be monitored for compliance.", {1}),
    "signature without closing": ("New text here.\n\nBob Lee\nField Service\nMobile 0000-123456", {1}),
    "list": ("Two points:\n- first one.\n2) second one.", {1, 2, 3}),
    "many thanks within": ("Many thanks for the drawing you sent.\n\nMany thanks,\nBob", {1}),
}


def mails(spark, rows):
    return spark.createDataFrame([(i, f, t, x, None, "c") for i, f, t, x in rows], "seg_id long, file_name string, doc_type string, text string, received_at timestamp, words string")


def test_structure(spark):
    rows = [(n, f"m{n}.eml", None, t) for n, (t, _) in enumerate(MAILS.values())]
    rows += [(90, "m90.msg", None, None), (91, "m91.eml", "x", ""), (92, "spec.pdf", "Supporting", "Not a mail."), (93, "x.txt", " raw email ", "A mail."), (94, None, None, "No.")]
    got = {}
    for r in k.written(mails(spark, rows)).collect():
        got.setdefault(r["seg_id"], set()).add(r["line_no"])
    names = list(MAILS)
    assert {names[i]: v for i, v in got.items() if i < 90} == {n: v for n, (_, v) in MAILS.items() if v}
    assert {i for i in got if i >= 90} == {93}
    assert k.written(mails(spark, rows).limit(0)).count() == 0


def test_boilerplate_and_inherited_text(spark):
    old = "The first sentence stands here. A second sentence follows it. The third one ends the matter."
    rows = [(n, f"b{n}.eml", None, f"Number {n} differs from the others in words like w{n} q{n}.\n\nThis footer has no legal words at all.") for n in range(12)]
    rows += [(50, "first.eml", None, old), (51, "late.eml", None, "Hello,\n\nWhat I add is this.\n\n" + old), (52, "first.eml", None, old)]
    assert found(spark, rows) == {**{n: {1} for n in range(12)}, 50: {1}, 51: {1, 3}, 52: {1}}


def found(spark, rows):
    df = mails(spark, rows).withColumn("received_at", k.F.timestamp_micros(k.F.col("seg_id") * 1_000_000))
    got = {}
    for r in k.written(df).collect():
        got.setdefault(r["seg_id"], set()).add(r["line_no"])
    return got


def test_disclaimers_are_learned_from_signed_parts(spark):
    notice = "Opinions in this letter are those of its author alone."
    closed = [(n, f"c{n}.eml", None, f"A text with words w{n} and v{n}.\n\nKind regards\nBob\n\n{notice}") for n in (1, 2)]
    loose = [(3, "x.eml", None, f"Some other text.\n\n{notice}"), (4, "y.msg", None, "Yet another matter.\n\n" + notice.replace("author", "auther"))]
    assert found(spark, closed + loose) == {n: {1} for n in (1, 2, 3, 4)}
    # Two mails are needed, and no more may have it as text.
    assert found(spark, closed[:1] + loose)[3] == {1, 3}
    more = [(10 + n, f"z{n}x{'ab'[n % 2]}.eml", None, f"{notice} Then w{n} follows v{n}.") for n in range(3)]
    assert found(spark, closed + loose + more)[3] == {1, 3}


def test_one_inherited_sentence_of_someone_in_the_conversation(spark):
    first = (1, "a.eml", None, "From: Ann Lee <ann@x.example>\nTo: Bob\nSubject: Pump\n\nThe third pump of 12 leaks at the northern flange again.")
    said = "The third pump of {} leaks at the northern flnge again.\n\nFitter number {} comes."
    head = "From: Bob Ray <bob@x.example>\nTo: {}\nSubject: Re: Pump\n\n"
    rows = [first, (2, "b.eml", None, head.format("Lee, Ann") + said.format(12, 1)), (3, "c.eml", None, head.format("Ann Lee") + said.format(13, 2)), (4, "d.eml", None, head.format("Zoe") + said.format(12, 3))]
    # Other figures, or nobody in common but the one who copies himself, make new text.
    assert found(spark, rows[:3]) == {1: {5}, 2: {7}, 3: {5, 7}}
    assert found(spark, [first, rows[3]]) == {1: {5}, 4: {5, 7}}


def edited(rng, text, n):
    letters = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(letters)), rng.randrange(3)
        letters[at : at + 1] = [] if kind == 0 else [rng.choice("abcdefghijklmnopqrstuvwxyz")] + letters[at : at + 1] * (kind == 1)
    return "".join(letters)


def test_near_matches_are_found_by_the_tables(spark):
    """Against brute force: one to three edits in sentences of six to twenty words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwygpb") for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(400)]
    held = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 20))) for _ in range(500)]
    asked = [(3 * i + e, edited(rng, t, e + 1)) for i, t in enumerate(held) for e in range(3)]
    far = lambda a, b: k.EDITS_PERCENT * max(len(a), len(b)) < 100 * levenshtein(a, b)
    true = {(i, i // 3) for i, t in asked if not far(t, held[i // 3])}
    got = k.near(spark.createDataFrame(asked, "id long, words string"), spark.createDataFrame(list(enumerate(held)), "other long, words string"), [])
    got = {(r["id"], r["other"]) for r in got.collect()}
    assert len(true) > 1000 and got <= true and len(got) >= 0.9 * len(true)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_people():
    assert k.person("Lee, Ann") == k.person('"Ann LEE" <x@y.example>') != k.person("Ann Lea") and k.person("<a@b.example>") == k.person("a@b.example")
    _, _, sender, people = k.parts("Yes.\n\nRegards\nBob Ray\n\nOn 1 May 2024 at 10:00, Ann Lee <a@x.example> wrote:\n> From: Zoe Orr\n> q")
    assert sender == k.person("bob ray") and people == {k.person("Bob Ray"), k.person("Ann Lee"), k.person("Zoe Orr")}
