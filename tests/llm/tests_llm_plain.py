"""Plain versions that several tests compare with."""


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def linked(texts, words, percent):
    """For each text the position of the first one that links lead to, by comparing all pairs."""
    sets, root = [shingles(t, words) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]
