"""Plain single-machine versions of the conversation operators, and conversations with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

SCHEMA = "conv_id long, turn long, role string, text string, name string, cost long, depth int"


def rows(seed: int = 3, convs: int = 60) -> list[tuple]:
    """Conversations with shared beginnings, faults, null values, equal turn numbers, repeated rows, gaps and one long one."""
    rng = random.Random(seed)
    say = ["Hello there.", "Yes", "No!", "", "  \n", "What now?", "Hello there.", "x" * 300 + ".", "日本 😀.", None]
    out = []
    for c in range(convs):
        c = c if c % 7 else c * 1000
        first = rng.choice(["system", "user", "user", "assistant", "tool"])
        turn = rng.choice([0, 0, 5, -3])
        for i in range(rng.randint(1, 12)):
            role = first if i == 0 else rng.choice(["user", "assistant", "assistant", "user", None, "system", "Tool", ""]) if rng.random() < 0.3 else ("user", "assistant")[i % 2]
            out.append((c, turn if rng.random() > 0.05 else None, role, rng.choice(say), "n", 7, 1))
            turn += rng.choice([1, 1, 1, 2, 0])
    out += [(999, i, ("user", "assistant")[(i + i // 97) % 2], f"line {i % 150}" + (".", "")[i % 31 == 0], "n", None, 1) for i in range(700)]
    out += [(-12, i % 40, "user", "same text.", None, None, None) for i in range(300)]
    out += [out[3], out[3], out[10], (None, 1, "user", "lost.", None, None, None), (None, None, None, None, None, None, None), (41, None, None, None, None, None, None)]
    rng.shuffle(out)
    return out


def truncated_mod(a: int, b: int) -> int:
    return a - b * int(a / b)


def trie(turns) -> dict:
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)}, and the members of each node are compared by it."""
    held = defaultdict(list)
    for c, t, role, text, *_ in turns:
        if c is not None:
            r, x = role or "", text or ""
            key = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
            held[c].append(((t is not None, t or 0), key, r, x))
    for v in held.values():
        v.sort(key=lambda e: e[:2])
    whole = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = [(r, x) for _, _, r, x in held.get(c - truncated_mod(c, 5), [])[:h]] + [(r, x) for _, _, r, x in own[h:]]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = {p: hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], ends[p]) for p, m in members.items())


def damaged(turns) -> dict:
    """{conv_id: its (turn, role, text) in order, after damage}."""
    held = defaultdict(list)
    for c, t, role, text, *_ in turns:
        held[c]
        text = " " if text is None else text
        role = " " if role is None else role
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        held[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for v in held.values():
        v.sort(key=lambda e: ((e[0] is not None, e[0] or 0), hashlib.sha256(f"{len(e[1])}:{e[1]}{e[2]}".encode()).digest()[:16]))
    return held


def repair(turns) -> dict:
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)} by a plain backward search over whole audits."""
    out = {}
    for c, seq in damaged(turns).items():
        numbers = [t for t, _, _ in seq if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, fault = set(), []
        for _, role, text in seq:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in seq]
        illegal = sum((a + b) not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}
        best = {"": (0, ()), "a": (0, ())}
        inf = (10**9, ())
        for i in range(len(seq), -1, -1):
            new = {}
            if i == len(seq):
                new = {s: best.get(s, inf) for s in ("", "s", "u", "a")}
            else:
                extra = 1 if fault[i] == "t" else 0
                for s in ("", "s", "u", "a"):
                    options = [(3 + best[s][0], (("D", None),) + best[s][1])]
                    if fault[i] not in ("b", "d"):
                        f = follow[s]
                        options.append((2 + extra + best[f][0], (("R", f),) + best[f][1]))
                        if initials[i] == f or (s == "" and initials[i] == "s"):
                            options.append((extra + best[initials[i]][0], (("K", None),) + best[initials[i]][1]))
                    new[s] = min(options, key=lambda o: (o[0], "".join(e for e, _ in o[1])))
            best = dict(new)
            for s in new:  # one or two insertions before this row; more return to a state already had
                path, state = [], s
                for _ in range(2):
                    state = follow[state]
                    path.append(("I", state))
                    best[s] = min(best[s], (2 * len(path) + new[state][0], tuple(path) + new[state][1]), key=lambda o: (o[0], "".join(e for e, _ in o[1])))
        cost, edits = best[""]
        names, lines, i = {"u": "user", "a": "assistant"}, [], 0
        for e, to in edits:
            if e == "I":
                lines.append(names[to] + ":")
                continue
            if e != "D":
                lines.append((names[to] if e == "R" else seq[i][1]) + ":" + seq[i][2])
            i += 1
        audit = "".join(e for e, _ in edits)
        out[c] = (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out
