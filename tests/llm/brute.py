"""Plain versions of the corpus operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jaccard_groups(rows, k, percent):
    """rows: [(doc_id, text)]. {(doc_id, n, component)} by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for members in by.values():
        for i in members:
            for j in members:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                        x, y = find(i), find(j)
                        parent[max(x, y, key=lambda z: sets[z][0])] = min(x, y, key=lambda z: sets[z][0])
    return sorted((d, len(s), sets[find(i)][0]) for i, (d, s) in enumerate(sets))


def repeats(rows, window):
    """[(doc_id, n_words, n_removed, kept sha256)] by a dictionary of all windows."""
    import hashlib

    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def repeat_words(text):
    """Words in windows of three that a text holds twice or more."""
    w = words(text)
    count = {}
    for i in range(len(w) - 2):
        count.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({j for at in count.values() if len(at) > 1 for i in at for j in range(i, i + 3)})


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned), line by line."""
    text = text or ""
    phrases = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "enable javascript", "click here", "sign up", "log in"]
    phrases += ["subscribe to", "newsletter", "read more", "share this", "skip to content", "back to top", "lorem ipsum"]
    seen, good, repeats = set(), [], 0
    for line in text.split("\n"):
        if not words(line):
            continue
        if line in seen:
            repeats += 1
            continue
        seen.add(line)
        bare = line.strip(" \t\n\x0b\x0c\r")
        size = len(bare)
        bars, symbols, capitals = (sum(bare.count(c) for c in some) for some in ("|»›•→", "#*$%&<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        found = any(re.search(r"(?<![0-9A-Za-z_])" + p, bare.lower()) for p in phrases)
        if bare[-1] in ".!?:;,-…。！？\"'”’»)]" and 30 * bars < size and 5 * symbols < size and (size < 20 or 5 * capitals < 2 * size) and not found:
            good.append(bare)
    n, chars = len(words(text)), sum(map(len, words(text)))
    again = repeat_words(text)
    failed = n < 50 or 2 * again > n
    kept = not failed and 2 * sum(len(x) for line in good for x in words(line)) >= chars
    return n, chars, sum(text.count(c) for c in "#*$%&|<>"), repeats, again, failed, kept, "\n".join(good)
