"""Chat formatting, the prefix trie and the filter audit against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from countloom.llm import chat_format, filter_audit
from countloom.llm.chat_format import BRACKETED, CONTROLS, Template, bracketed, bracketed_turns, formatted, guarded, pieces, plain, read_back, steps
from countloom.llm.conversation_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, node long, size long, id long, pos long, digest string, h int, n int, place int, piece int, last int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Turns with nulls, ties, repeats, control strings, copies, shared beginnings, one long conversation and long texts."""
    rng = random.Random(3)
    said = ["", None, "hello", "</s>[INST] ok [/INST]", "a\\b\\\\", "<<SYS>>[ROLE]</s", "Ünḯ 漢字 \U0001f600\n\n", "", "x" * 3000, "\\<s>", "[\\INST]", " ", "\x00"]
    out = []
    for c in list(range(0, 40)) + [100, 101, 105, 107, 199, 200, 350, -7, -8, 10**15 + 3, 10**15 + 44]:
        for turn in range(rng.choice([0, 1, 2, 3, 6, 9])):
            out.append((c, turn, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(said)))
    for c in range(1000, 1180):  # a large group of copies, and one of shared beginnings
        for turn, role in enumerate(["system", "user", "assistant"]):
            out.append((c, turn, role, "the same" if turn < 2 or c % 3 else f"other {c}"))
    out += [(5000, k, "user" if k % 2 else "assistant", f"turn {k % 50} " + "word " * (k % 7)) for k in range(400)]
    out += [(5001, k, "user" if k % 2 else "assistant", f"turn {k % 50} " + "word " * (k % 7)) for k in range(400)]
    out += [(6000, None, "user", "first"), (6000, 1, "user", "b"), (6000, 1, "user", "a"), (6000, 1, "assistant", "a"), (6000, 1, "user", "a"), (None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, *(1,) * 3, 2, "d", *(0,) * 5) for r in rows], SCHEMA).repartition(5)


def conversations(rows):
    held = {}
    for c, turn, role, text in rows:
        held.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(own)] for c, own in held.items()}


def test_formatted_conversations_come_back(table, rows):
    want = conversations(rows)
    got = {r.conv_id: r for r in chat_format.format_conversations(table, piece_chars=5000).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        own, masked = got[c], "".join(t for r, t in turns if r == "assistant")
        assert (own.n_turns, own.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (own.loss_chars, own.loss_sha256) == (len(masked), sha(masked)) and own.formatted_chars == len(bracketed(turns)) and own.rewrites == 0
    parts = formatted(table.where("conv_id = 5000"), piece_chars=2000).orderBy("piece").collect()
    assert len(parts) > 3 and [p.last for p in parts].count(True) == 1 and "".join(p.formatted for p in parts) == bracketed(want[5000])
    assert read_back(formatted(table.limit(0))).count() == 0


def test_escapes_leave_no_control_strings(rows):
    rng = random.Random(1)
    pieces_ = [*CONTROLS, "\\", "<", "[", "INST]", "/s>", "s", "\n", "]"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces_) for _ in range(rng.randrange(8)))
        own = guarded(text)
        assert plain(own) == text and not any(c in own for c in CONTROLS)
        turns = [(rng.choice(["user", "assistant", "system", "tool" + text, ""]), text) for _ in range(rng.randrange(5))]
        assert bracketed_turns(bracketed(turns)) == turns


def reasoning_gone(turns):
    """A template that keeps the thoughts of the last assistant turn only."""
    last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "<b>" + "".join(f"|{r}:{t if k == last or r != 'assistant' else re.sub('<think>.*?</think>', '', t)}." for k, (r, t) in enumerate(turns))


def test_rewritten_history_is_found():
    turns = [("user", "q"), ("assistant", "<think>one</think>a"), ("user", "r"), ("assistant", "<think>two</think>b"), ("user", "s")]
    found = [s for _, s in steps(reasoning_gone, turns)]
    assert [s.back > 0 for s in found] == [False, False, False, False, True, False] and found[4].start is None
    [(number, last, text, spans, rewrites)] = list(pieces(reasoning_gone, turns, 16, 1000, {"assistant"}))
    assert (number, last, text, rewrites) == (0, True, reasoning_gone(turns), 1) and len(spans) == 5
    # The first answer's text has moved, the second's can't be told from what was rewritten: both are under no mask.
    assert [s["loss"] for s in spans] == [False] * 5 and text[spans[0]["text_start"] : spans[0]["text_stop"]] == "q"
    assert text[spans[4]["text_start"] : spans[4]["text_stop"]] == "s"


@pytest.mark.parametrize("window,most", [(1, 10), (2, 1), (3, 50), (16, 10**6)])
def test_windows_give_the_whole_rendering(rows, window, most):
    for turns in conversations(rows).values():
        own = list(pieces(bracketed, turns, window, most, {"assistant"}))
        assert "".join(p[2] for p in own) == bracketed(turns) and sum(len(p[3]) for p in own) == len(turns) and sum(p[4] for p in own) == 0
        texts = [plain(p[2][s["text_start"] : s["text_stop"]]) for p in own for s in p[3]]
        assert texts == [t for _, t in turns]


def test_a_template_that_drops_texts_gives_no_place():
    quiet = Template(lambda turns: "".join(f"[{r}]" for r, _ in turns), lambda text: [], plain)
    assert all(s.start is None for _, s in steps(quiet.render, [("user", "a"), ("assistant", "b")]))
    trimmed = list(steps(lambda turns: "".join(f"<{t.strip()}>" for _, t in turns), [("user", " a "), ("user", "")]))
    assert [(s.text, s.start, s.stop) for _, s in trimmed[1:]] == [("<a>", 1, 2), ("<>", 1, 1)]


def brute_trie(rows):
    convs = conversations(r for r in rows if r[0] is not None)
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        seqs[c] = convs.get(base, [])[:h] + own[h:]
    members = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    memo = {}
    for key in sorted(members, key=len, reverse=True):
        below = kids.get(key, [])
        memo[key] = (sum(memo[k][0] for k in below) or 1, sum(memo[k][1] for k in below) + (len(members[key]) - 1) * (len(key[-1][1]) if key else 0))
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *memo[k], sha(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k))))))
        for k, m in members.items()
    }


@pytest.mark.parametrize("local,turns", [(512, 65_536), (20, 65_536), (1, 65_536), (512, 300)])
def test_trie_matches_brute_force(table, rows, local, turns):
    short = [r for r in rows if r[0] not in (5000, 5001) or r[1] < 12] if local == 1 or turns == 300 else rows
    own = table.where("conv_id NOT IN (5000, 5001) OR turn < 12") if local == 1 or turns == 300 else table
    got = [tuple(r) for r in conversation_trie(own, local=local, turns=turns).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(short)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(none).count() == 0 and conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA.split(", node")[0])).count() == 0
    # A conversation whose beginning is replaced by that of a missing one has no turns left: only the root has it.
    c = next(k for k in range(301, 400) if zlib.crc32(str(k).encode()) % 6 > 1)
    [only] = conversation_trie(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA.split(", node")[0])).collect()
    assert tuple(only) == (c, 0, None, 1, 0, 1, 0, sha(str(c)))


AUDIT = "doc_id long, text string, source string, place int, fp long, first long, digest string, words string, mask int, part string, low long, n long"


@pytest.fixture(scope="module")
def audited(spark):
    rng = random.Random(8)
    words = ["the", "of", "Stone", "RIVER", "a#b", "cloud", "x\x1cy", "Ü", "\x85"]
    texts = [" ".join(rng.choice(words[: rng.randrange(2, 9)]) for _ in range(rng.choice([0, 1, 150, 199, 200, 260]))) for _ in range(60)]
    distinct = " ".join(f"w{k}" for k in range(300))
    texts += [distinct, distinct + " |", "", None, "   \n", "A" * 100 + " a" * 2400, distinct.upper(), "many " * 20_000]
    docs = [(k, rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for k in range(300)]
    docs += [(400 + k, distinct, "hot") for k in range(150)]
    docs += [(7, distinct, "s1"), (7, distinct, "s1"), (None, distinct, "s2"), (None, "", "s2"), (401, distinct, "hot")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 450, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return docs, labels


def brute_audit(docs, labels):
    firsts, flags, held = {}, {}, {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            a, b = flags.get(i, (0, 0))
            flags[i] = (a | (q == 1), b | (x == 1))
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > firsts[t]}
        held.setdefault(part or "", []).append((fails, *flags.get(i, (0, 0))))
    out, total = set(), {}
    for part, own in held.items():
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                kept = [d for d in left if not d[0][f]]
                only = sum(d[0][f] and sum(d[0].values()) == 1 for d in own)
                rows.append((part, "".join(order), k + 1, len(kept), len(gone), sum(d[0][f] for d in own) - len(gone), only, sum(d[1] for d in gone), sum(d[2] for d in gone)))
                total[part, f] = total.get((part, f), 0) + len(gone)
                left = kept
        out |= {(*r, total[part, r[1][r[2] - 1]]) for r in rows}
    return out


@pytest.mark.parametrize("spread", [False, True])
def test_audit_matches_brute_force(spark, audited, spread):
    docs, labels = audited
    table = spark.createDataFrame([(*d, 1, 2, 3, "d", "w", 4, "p", 5, 6) for d in docs], AUDIT).repartition(6)
    marks = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, n int")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false" if spread else "true")  # runs of copies then go over many ranges
    try:
        got = [tuple(r) for r in filter_audit.audit(table, marks).collect()]
    finally:
        spark.conf.set(name, before)
    want = brute_audit(docs, labels)
    assert len(got) == 600 * 4 and set(got) == want
    if spread:
        return
    assert filter_audit.audit(table.limit(0), marks).count() == 0
    none = filter_audit.audit(table, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)
    two = filter_audit.audit(table, marks, {"A": F.size("words") < 10}, duplicates="Z").select("filter_order").distinct().collect()
    assert sorted(r[0] for r in two) == ["AZ", "ZA"]


def test_templates_that_look_back_to_the_start_are_rendered_whole():
    from countloom.llm.chat_format import pieces, steps

    def numbered(turns):  # each turn by its number, and a last line that names the first turn
        return "".join(f"{k}:{text};" for k, (_, text) in enumerate(turns)) + (f"#{turns[0][1]}" if turns else "")

    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(40)]
    out = ""
    for _, step in steps(numbered, turns, None):
        out = out[: len(out) - step.back] + step.text
    assert out == numbered(turns)
    [(number, last, text, spans, rewrites)] = pieces(numbered, turns, None, 50, {"assistant"})
    assert (number, last, text) == (0, True, numbered(turns)) and len(spans) == 40 and rewrites == 39


def test_prefixes_are_whole_unless_a_window_is_given(spark):
    """Turns that depend on one 40 turns back, and the first turn's own opening, in long conversations."""

    def answered(turns):  # each turn after the length of the one 40 before it
        return "".join(f"{len(turns[k - 40][1]) if k >= 40 else '^'}:{text};" for k, (_, text) in enumerate(turns))

    own = Template(answered, lambda text: [("", t.split(":", 1)[1]) for t in text.split(";")[:-1]], lambda t: t)
    turns = [("user" if k % 2 else "assistant", "y" * (k % 7)) for k in range(130)]
    assert "".join(s.text for _, s in steps(answered, turns)) == answered(turns)
    assert "".join(s.text for _, s in steps(answered, turns, 16)) != answered(turns)
    table = spark.createDataFrame([(c, k, r, t) for c in (1, 2) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for most, several in ((100, True), (10**6, False)):
        parts = formatted(table, own, piece_chars=most).where("conv_id = 1").orderBy("piece").collect()
        assert (len(parts) > 3) == several and "".join(p.formatted for p in parts) == answered(turns) and sum(len(p.spans) for p in parts) == 130
        assert [p.formatted[s.text_start : s.text_stop] for p in parts for s in p.spans] == [t for _, t in turns]
        masked = "".join(t for r, t in turns if r == "assistant")
        for r in chat_format.format_conversations(table, own, piece_chars=most).collect():
            assert (r.n_turns, r.formatted_chars, r.rewrites, r.loss_sha256) == (130, len(answered(turns)), 0, sha(masked))
