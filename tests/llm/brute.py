"""Plain Python versions of the contracts, written from their wording."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc_of(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(digits[::-1]):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text) -> list:
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def rule_counts(text) -> dict:
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for k in range(len(ws) - 7):
        windows[tuple(ws[k : k + 8])].append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": failed,
    }


def base_scores(docs) -> list:
    """(n_tokens, n_known, train_tokens, base_score) of (doc_id, text) rows."""
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in docs]
    counts = Counter(w for (d, _), ws in zip(docs, tokens) if crc_of(d) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for ws in tokens
    ]


def mix_targets(sizes: dict) -> dict:
    """Targets by source: share by weight, cut what is above the cap, share that again."""
    order = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def fingerprint(text) -> int:
    ws = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def classes(fps: list) -> list:
    """Smallest position reachable over links of at most three bits, for each position."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def token_rows(docs, tokenizer) -> list:
    """(doc_id, start, n_tokens, crc) of (doc_id, text) rows that are in order."""
    out, start = [], 0
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def shingle_classes(docs) -> list:
    """(n_shingles, component_id) of each (doc_id, text) row, by comparing all pairs of sets."""
    sets = []
    for _, t in docs:
        ws = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(zip(ws, ws[1:])) or frozenset([tuple(ws)] if ws else []))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least: dict = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [(len(s), least.get(find(k))) for k, s in enumerate(sets)]


def filter_rows(docs, labels) -> set:
    """The audit's rows from (doc_id, text, source) and (doc_id, quality, toxic) rows, document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    least: dict = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, s in docs:
        t = t or ""
        ws = WORD.findall(t)
        told = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and d > least[t],
        }
        fails.append((s or "", d, {f for f, x in told.items() if x}))
    counts: dict = {}
    for part in {p for p, *_ in fails}:
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                row = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0)
                before = set(order[:step])
                for p, d, bad in fails:
                    if p == part:
                        here = f in bad and not bad & before
                        row["removed"] += here
                        row["kept"] += not bad & (before | {f})
                        row["redundant"] += f in bad and bool(bad & before)
                        row["unique_fails"] += bad == {f}
                        row["good_lost"] += here and d in good
                        row["toxic_lost"] += here and d in toxic
                counts[part, "".join(order), step + 1] = row
    shapley = Counter()
    for (part, order, step), row in counts.items():
        shapley[part, order[step - 1]] += row["removed"]
    return {(*key, *row.values(), shapley[key[0], key[1][key[2] - 1]]) for key, row in counts.items()}


def trie_rows(turns) -> set:
    """The trie's nodes from (conv_id, turn, role, text) rows; ties by the SHA-256 of role and text."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(rows)] for c, rows in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = Counter(path[:-1] for path in members if path)
    rows = set()
    for path, cs in members.items():
        below = [y for y in members if y[: len(path)] == path]
        saved = sum((len(members[y]) - 1) * len(WORD.findall(y[-1][1])) for y in below if y)
        leaves = sum(not children[y] for y in below)
        ends = ",".join(str(c) for c in sorted(c for c in cs if whole[c] == path))
        rows.add((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), children[path], leaves, saved, sha(ends)))
    return rows
