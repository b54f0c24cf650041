"""Plain versions of the text operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def context_trees(rows, depth):
    """id -> (tokens, known tokens, training tokens, baseline, score) by explicit trees."""
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter()
    for t in train:
        counts.update([*words(lower(t)), None])
    total, kinds = sum(counts.values()), len(counts)
    node = defaultdict(lambda: [0, 0])

    def decisions(t):
        body = b" ".join(words(lower(t))) + b"\xff"
        whole = b"\xff" * depth + body
        for k, byte in enumerate(body):
            context = whole[k : k + depth][::-1]
            for level in range(8):
                yield context, (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1

    for t in train:
        for context, number, bit in decisions(t):
            for d in range(depth + 1):
                node[number, context[:d]][bit] += 1
    children = defaultdict(list)
    for number, context in node:
        if context:
            children[number, context[:-1]].append((number, context))
    value, share = {}, {}
    for key in sorted(node, key=lambda k: -len(k[1])):
        own = log_kt(*node[key])
        if len(key[1]) == depth:
            value[key], share[key] = own, 1.0
            continue
        below = sum(value[c] for c in children[key])
        top = max(own, below)
        value[key] = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
        share[key] = math.exp(own - math.log(2) - value[key])
    out = []
    for i, t in rows:
        tokens = [*words(lower(t)), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        score = 0.0
        for context, number, bit in decisions(t):
            mix = None
            for d in range(depth, -1, -1):
                zeros, ones = node.get((number, context[:d]), (0, 0))
                one = (ones + 0.5) / (zeros + ones + 1)
                own = share.get((number, context[:d]), 0.5 if d < depth else 1.0)
                mix = one if mix is None else own * one + (1 - own) * mix
            score += math.log10(mix if bit else 1 - mix)
        out.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), total, base, score))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, size=5):
    found = words(lower(text))
    if not found:
        return set()
    return {tuple(found[k : k + size]) for k in range(max(1, len(found) - size + 1))}


def near_components(rows):
    """One (id, set size, component) per row, from all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y:
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def best_fit(lengths, capacity):
    """Number of rows of best-fit-decreasing by trying every row."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(capacity - n)
    return len(free)


def entropy(text):
    counts = Counter(text)
    return -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())


def sha_hex(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_proofs(rows, fields=("doc_id", "source", "lang", "n_chars", "text")):
    """(doc_id, leaf, subroot, root, proof, folded) of each row, by plain lists."""

    def leaf_of(row):
        parts = ["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in fields]
        return sha_hex(parts)

    def level_up(digests):
        return [sha_hex(digests[k : k + 16]) for k in range(0, len(digests), 16)]

    def path(tower, at):
        """Siblings per level, with the place of the own digest among them."""
        for digests in tower[:-1]:
            run = digests[at // 16 * 16 : at // 16 * 16 + 16]
            yield run[: at % 16], run[at % 16 + 1 :]
            at //= 16

    def tower(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append(level_up(levels[-1]))
        return levels

    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append((leaf_of(row), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    towers = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        towers[s] = tower([x[0] for x in by_source[s]])
    top = tower([towers[s][-1][0] for s in names])
    out = []
    for number, s in enumerate(names):
        for at, (digest, row) in enumerate(by_source[s]):
            siblings = [*path(towers[s], at), *path(top, number)]
            other = dict(row)
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                other["text"] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"])
            folded = leaf_of(other)
            for left, right in siblings:
                folded = sha_hex([*left, folded, *right])
            proof = sha_hex([d for left, right in siblings for d in left + right])
            out.append((row["doc_id"], digest, towers[s][-1][0], top[-1][0], proof, folded))
    return out


def conversation_trie(rows, group=100, limit=6, tie=lambda role, text: (role, text)):
    """One tuple per node of the trie, from (conv_id, turn, role, text) rows, by plain dictionaries."""
    original = {}
    for c, turn, role, text in rows:
        if c is not None:
            original.setdefault(c, []).append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    original = {c: [x[3:] for x in sorted(v)] for c, v in original.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % limit
        rebuilt[c] = tuple(original.get(c - c % group, [])[:h] + own[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children.get(node, [])), leaves[node], saved[node], sha_hex([",".join(map(str, ends))])))
    return out
