import functools
import hashlib
import itertools
import random
import re
import zlib

from llm.helpers import rows_of

from offermend.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """Rows after damage by conversation, in order of turn, role and the text's digest."""
    by = {}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text = said(role), said(text)
        h = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by.setdefault(conv, []).extend([] if h == 0 else [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1))
    for found in by.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return by


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows) by trying every edit in every state, ties by the audit itself."""

    @functools.cache
    def go(i, shape, ins):
        # shape: what the output's initials have come to; ins: rows put in since the last row
        best = None
        done = shape in ("", "a")
        if i == len(rows):
            if done:
                best = (0, "", ())
        else:
            _, role, text = rows[i]
            options = [(2, "D", shape, None)]
            if found[i] not in ("blank", "duplicate"):
                extra = 5 if found[i] == "truncated" else 0
                options += [(extra, "K", role[:1], (role, text))] + [(1 + extra, "R", r[0], (r, text)) for r in ("user", "assistant")]
            for cost, letter, to, row in options:
                if letter != "D" and (not to or shape + to not in ("s", "u", "su", "ua", "au")):
                    continue
                rest = go(i + 1, to, 0)
                if rest:
                    c = (cost + rest[0], letter + rest[1], ((row,) if row else ()) + rest[2])
                    best = c if best is None or c[:2] < best[:2] else best
        if ins < 3:
            for role in ("user", "assistant"):
                if shape + role[0] in ("u", "su", "ua", "au"):
                    rest = go(i, role[0], ins + 1)
                    if rest:
                        c = (5 + rest[0], "I" + rest[1], ((role, ""),) + rest[2])
                        best = c if best is None or c[:2] < best[:2] else best
        return best

    return go(0, "", 0)


def brute(rows):
    out = []
    for conv, found in damaged(rows).items():
        fault = faults(found)
        cost, audit, repaired = cheapest(found, fault)
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def made(rng, conversations):
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.5 else ["user", "assistant"][t % 2]
            role = rng.choice(["system", "tool", "", None, "sage", "ü"]) if rng.random() < 0.15 else role
            text = rng.choice([None, "", " \t", "yes.", "no", "Why? ", "same.", "é!", "…"]) if rng.random() < 0.6 else f"said {rng.randrange(99)}."
            turn = rng.choice([None, t * 3, -t]) if rng.random() < 0.1 else t
            rows.append((c if c % 17 else None, turn, role, text))
    return rows


def test_report_equals_brute_force(spark):
    rng = random.Random(11)
    rows = made(rng, 250)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS c", "'x' AS audit").repartition(3)
    assert rows_of(conversation.report(conversation.damage(frame))) == brute(rows)


def test_repaired_rows_follow_the_grammar_and_a_long_conversation_passes(spark):
    rows = [(1, t, ["user", "assistant"][t % 2 if t % 11 else 0], f"text {t}.") for t in range(3 * conversation.PIECE)] + [(2, 0, "assistant", "alone.")] + [(3, 0, "system", "only.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in conversation.repaired(conversation.as_rows(frame)).collect())
    for conv in (1, 2, 3):
        assert re.fullmatch("(s?(ua)+)?", "".join(r[2][0] for r in got if r[0] == conv))
    assert [r[1] for r in got if r[0] == 1] == list(range(sum(r[0] == 1 for r in got)))
    told = {r["c"]: r for r in conversation.report(conversation.as_rows(frame)).collect()}
    text = "\n".join(f"{r[2]}:{r[3]}" for r in got if r[0] == 1)
    assert told[1]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert (told[2]["cost"], told[2]["audit"]) == (2, "D") and (told[3]["cost"], told[3]["audit"]) == (2, "D")


def test_every_block_length_gives_the_same_repair():
    rng = random.Random(2)
    tables = [conversation.Tables(block) for block in (1, 2, 3, 4)]
    for _ in range(300):
        symbols = bytes(rng.randrange(conversation.SYMBOLS) for _ in range(rng.randrange(30)))
        assert len({str(t.repair(symbols)) for t in tables}) == 1


def test_empty_table(spark):
    assert conversation.report(conversation.damage(spark.createDataFrame([], SCHEMA))).count() == 0
