import hashlib
import itertools
import random
import re
import zlib

import pytest

from cityweave.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string, block string"


def hurt(rows):
    """Rows after damage, by conversation and in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows, found):
    """The cheapest (cost, audit, lines), every combination of edits tried."""
    best = (2 * len(rows), "D" * len(rows), [])
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in found]
    for edits in itertools.product(*choices):
        for ins in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            n_ins = sum(map(len, ins))
            if 5 * n_ins > best[0]:
                continue
            cost, audit, lines, initials = 5 * n_ins, "", [], ""
            for k, edit in enumerate([*edits, None]):
                for c in ins[k]:
                    audit, initials = audit + "I", initials + c
                    lines.append({"u": "user:", "a": "assistant:"}[c])
                if edit is None:
                    break
                audit += edit[0]
                cost += {"D": 2, "K": 0, "R": 1}[edit[0]] + 5 * (edit != "D" and found[k] == "truncated")
                if edit != "D":
                    role = {"K": rows[k][1], "Ru": "user", "Ra": "assistant"}[edit]
                    initials += role[:1] or "-"
                    lines.append(f"{role}:{rows[k][2]}")
            if re.fullmatch("(s?(ua)+)?", initials) and (cost, audit) < best[:2]:
                best = (cost, audit, lines)
    return best


def by_table(rows, found):
    """The same by a table over rows and the last initial, for longer conversations."""
    best = {"": (0, "", [])}

    def grown(now):
        for _ in range(2):
            for last, (cost, audit, lines) in list(now.items()):
                for new, name in (("u", "user"), ("a", "assistant")):
                    if (new == "a") == (last == "u"):
                        now[new] = min(now.get(new, (9**9,)), (cost + 5, audit + "I", [*lines, f"{name}:"]))
        return now

    best = grown(best)
    for (_, role, text), f in zip(rows, found):
        now = {last: (c + 2, w + "D", x) for last, (c, w, x) in best.items()}
        if f not in ("blank", "duplicate"):
            for last, (c, w, x) in best.items():
                c += 5 * (f == "truncated")
                new, name = ("a", "assistant") if last == "u" else ("u", "user")
                options = [(new, c + 1, "R", name)]
                if role[:1] == new:
                    options.append((new, c, "K", role))
                if not last and role[:1] == "s":
                    options.append(("s", c, "K", role))
                for n, cost, e, r in options:
                    now[n] = min(now.get(n, (9**9,)), (cost, w + e, [*x, f"{r}:{text}"]))
        best = grown(now)
    return min(best[e] for e in ("", "a") if e in best)


def brute(rows, cheapest):
    out = []
    for conv, mine in hurt(rows).items():
        found = faults(mine)
        turns = {r[0] for r in mine} - {None}
        cost, audit, lines = cheapest(mine, found)
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(mine))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS).repartition(parts)
    return sorted(map(tuple, repair.damaged_and_repaired(df).collect()), key=str)


def made(r, conv, n, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None), texts=("Yes.", "No!", "cut", " \t\n", "", None, "é?\n ", "x.\x1c", "Who?")):
    turns = sorted(r.sample(range(n + 3), n))
    return [(conv, None if r.random() < 0.1 else t, r.choice(roles), r.choice(texts)) for t in turns]


def test_against_all_edits(spark):
    r = random.Random(3)
    rows = [row for conv in range(160) for row in made(r, conv, r.randint(0, 3))] + made(r, None, 3)
    want = brute(rows, all_edits)
    assert want == brute(rows, by_table)
    assert run(spark, rows) == want


@pytest.mark.parametrize("bits", [0, 2, 8])
def test_segments_of_any_size(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    r = random.Random(4)
    texts = [f"t{k}." for k in range(60)] + ["cut", "Yes.", " "]
    rows = [row for conv, n in enumerate([1, 2, 7, 40, 150]) for row in made(r, conv, n, ("system", "user", "assistant", "user", "assistant"), texts)]
    rows += [(77, t, ("user", "assistant")[t % 2], f"word {t}.") for t in range(300)]
    assert run(spark, rows) == brute(rows, by_table)


def test_one_long_text_ties_and_repeated_rows(spark):
    rows = [(1, 1, "user", "word " * 300_000 + "."), (1, 2, "assistant", "a" * 100_000)] + [(2, 5, "user", "same.")] * 50 + [(2, 5, "assistant", "same."), (2, 5, "assistant", "other."), (3, None, "user", "x.")] + [(None, None, "user", "x.")] * 2
    assert run(spark, rows) == brute(rows, by_table)


def test_all_dropped_and_empty(spark):
    gone = [(c, 0) for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = run(spark, [(*x, "user", "Hi.") for x in gone])
    assert [x[1:] for x in got] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 3 and len(got) == 3
    assert run(spark, []) == []


def test_far_turns(spark):
    spare = [c for c in range(300) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (-(2**62), 2**62, 2**63 - 1))][0]
    got = run(spark, [(spare, -(2**62), "user", "a."), (spare, 2**62, "assistant", "b.")])
    assert got[0][1] is None  # 2^63 - 1 would fit
    got = run(spark, [(spare, 2**62, "user", "a."), (spare, 2**63 - 1, "assistant", "b.")])
    assert got[0][1] == 2**62 - 2


def test_the_chart_keeps_the_least_audit_of_equal_costs():
    fine = lambda roles: "".join(chr(65 + 4 * repair.ROLES.index(c)) for c in roles)
    assert repair.earley(fine("uua"), "Z")["A"] == (2, "DKK")
    assert repair.earley(fine("sua"), "Z")["A"] == (0, "KKK")
    assert repair.earley(fine("au"), "Z")["A"] == (2, "RR")
    assert repair.earley("", "Z") == {"Z": (0, ""), "U": (5, "I"), "A": (10, "II")}
    assert repair.earley(fine("a"), "U") == {"U": (2, "D"), "A": (0, "K")} | {"U": min((2, "D"), (6, "KI"))}


def test_the_query_on_its_table(spark):
    from cityweave.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.QUERIES["op11_earley_repair"](spark, folder).collect()), key=str)
    assert got == brute(rows, by_table) and len({x[0] for x in got}) == len({r[0] for r in rows})
    assert sum(x[3] for x in got) and sum(x[4] for x in got) and {c for x in got for c in x[7]} >= set("DK")
