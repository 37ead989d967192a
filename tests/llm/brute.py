"""Plain single-machine versions of the operators' results."""

import hashlib
import math
import random
import re
import zlib

from xxhash import xxh64_intdigest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(texts, k, bits=4):
    """doc_id -> (fingerprint, smallest doc_id reachable) by comparing all pairs."""
    fp = {d: simhash(t, k) for d, t in texts.items()}
    up = {d: d for d in fp}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (fp[d], root(d)) for d in ids}


def secrets(text):
    """Base spans as (start, order of kind, end)."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for order, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), order, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def repeat_words(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {i for i, w in enumerate(windows) if windows.count(w) > 1}
    return len({i + k for i in twice for k in range(5)})


def odd_texts():
    """Nulls, empties, ties, repeats and a very long text."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Ünder", "x=1", "naïve", "Zed."]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = say(60_000)
    texts = [None, "", "  \n\t ", "one", "one two three", say(30), say(400), long, say(12) + "\n" + say(200)]
    texts += [texts[6], texts[6] + " end", texts[6].upper(), "\x1c odd\x1fone ", "a b 　 c", "password = hunter2secret\n" + say(20), "end <|endoftext|> of <|startoftext|>x <|ENDOFTEXT|>"]
    return list(enumerate(texts))


def damaged_conversations(rows):
    """conv_id -> [(turn, role, text)] after the damage, in order; rows are (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())) for c, own in out.items()}


def repaired_conversation(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of ordered rows, by comparing whole (cost, audit) pairs."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    if role[0] in after[s]:
                        to, new = after[s][role[0]], (cost + 2, audit + "I", out + (f"{role}:",))
                        if to not in states or new < states[to]:
                            states[to] = new
        return states

    states = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def put(s, value):
            if s not in new or value < new[s]:
                new[s] = value

        for s, (cost, audit, out) in inserted(states).items():
            put(s, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] in after[s]:
                put(after[s][role[:1]], (cost + more, audit + "K", out + (f"{role}:{text}",)))
            for to in ("user", "assistant"):
                if to[0] in after[s]:
                    put(after[s][to[0]], (cost + 2 + more, audit + "R", out + (f"{to}:{text}",)))
        states = new
    cost, audit, out = min(v for s, v in inserted(states).items() if s in ("", "a"))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def clusters(vectors, k=40, rounds=5, seed=2):
    """vec_id -> (cluster, distance, centroid) in Python's integers; vectors is a list of (vec_id, components)."""
    kept = [(v, [math.floor(256 * x) for x in e]) for v, e in vectors if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [e for _, e in first]
    near = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, e in kept:
            own.setdefault(near(e)[1], []).append(e)
        for n, members in own.items():
            centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    return [(v, n, d, centroids[n]) for v, e in kept for d, n in [near(e)]]


def personal(text):
    """Base spans as (start, order of kind, end), by the plain patterns."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c not in " -"][::-1]
        if 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)
