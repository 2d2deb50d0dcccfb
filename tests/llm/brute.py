"""Plain Python versions of what the corpus operators must return."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def crc(text):
    return zlib.crc32((text or "").encode())


def decontaminated(text, items, width=10):
    words, hit, found = alnum_words(text), set(), set()
    for item_id, item in items:
        item_words = alnum_words(item)
        size = min(width, len(item_words))
        windows = {tuple(item_words[k : k + size]) for k in range(len(item_words) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add("" if item_id is None else str(item_id))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, bool(hit)


def base_scores(docs):
    """(doc_id, text) rows -> rows of (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    counts, ends = Counter(), 0
    for (_, text), h in zip(docs, held):
        if not h:
            counts.update(space_words(text, lower=True))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for (i, text), h in zip(docs, held):
        words = space_words(text, lower=True)
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        out.append((i, h, len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), n, score))
    return out


def quality(text):
    text = text or ""
    words = space_words(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts, repeated = Counter(windows), set()
    for k, w in enumerate(windows):
        if counts[w] > 1:
            repeated.update(range(k, k + 3))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def without_repeats(docs, width=13):
    """(doc_id, text) rows -> (doc_id, n_words, n_removed, kept_sha256) rows."""
    last = math.inf
    first = {}
    rank = lambda i: last if i is None else i
    rows = [(rank(i), space_words(text)) for i, text in docs]
    for r, words in rows:
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            first[window] = min(first.get(window, last), r)
    out = []
    for (i, _), (r, words) in zip(docs, rows):
        gone = {p for k in range(len(words) - width + 1) if first[tuple(words[k : k + width])] < r for p in range(k, k + width)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near_groups(docs, width=3, percent=85):
    """(doc_id, text) rows -> (doc_id, n_shingles, component_id, kept) rows."""
    sets = []
    for _, text in docs:
        w = space_words(text, lower=True)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = [k for k, (i, _) in enumerate(docs) if i is not None and sets[k]]
    for a in some:
        for b in some:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k in some:
        least[root(k)] = min(least.get(root(k), docs[k][0]), docs[k][0])
    out = []
    for k, (i, _) in enumerate(docs):
        component = least[root(k)] if k in some else i
        out.append((i, len(sets[k]), component, i is None or i == component))
    return out


def base_licences(text):
    words = alnum_words(text)
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        places = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += places
        labels |= {label} if places else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def article_text(page):
    """Blocks of the one article element of a plain page."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.sub(r"</?(?:p|h1)>", "\0", inside).split("\0")
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks) if t)


def lattice_scores(rows, model_file):
    """(doc_id, log10 probability) of every row, in plain probabilities: the sum over all ways to cut each word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    docs = [(i, (t or "").encode("utf-8", "surrogatepass").lower().split()) for i, t in rows]
    trained = [words for i, words in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = Counter({2: len(trained)})
    for word, n in Counter(w for words in trained for w in words).items():
        for piece in model.encode(word.decode("utf-8", "replace")):
            counts[piece] += n
    ids = [i for i in range(model.get_piece_size()) if not model.is_unknown(i) and (i == 2 or not model.is_control(i))]
    whole = sum(counts[i] for i in ids) + len(ids)
    share = {model.id_to_piece(i): (counts[i] + 1) / whole for i in ids}
    end, longest = share.pop(model.id_to_piece(2)), max(len(p) for p in share)

    def log10_of(word):
        text = "▁" + word.decode("utf-8", "surrogatepass")
        ways = [1.0] + [0.0] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + longest) + 1):
                part = text[i:j]
                if part in share and not (model.is_byte(model.piece_to_id(part))):
                    ways[j] += ways[i] * share[part]
                elif j == i + 1:
                    ways[j] += ways[i] * math.prod(share[f"<0x{b:02X}>"] for b in part.encode("utf-8", "surrogatepass"))
        return math.log10(ways[-1])

    known = {w: log10_of(w) for _, words in docs for w in words}
    return [(i, sum(map(known.__getitem__, words)) + math.log10(end)) for i, words in docs]


def licences(rows, templates, least, drift):
    """(doc_id, labels, score) of every row: every template is tried at every place of every text."""
    docs = [(i, alnum_words(t)) for i, t in rows]
    counts = Counter(w for _, words in docs for w in set(words))
    idf = {w: math.log((1 + len(docs)) / (1 + counts[w])) for t in templates for w in t.words}
    out = []
    for i, words in docs:
        labels, best = {x for x in base_licences(" ".join(words))[-1].split(",") if x}, 0.0
        for t in templates:
            n = len(t.key)
            key = next(q for q in range(len(t.words)) if t.words[q : q + n] == t.key)
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) != t.key:
                    continue
                stand = [
                    key <= q < key + n or any(
                        words[p] == w and (p < at if q < key else p >= at + n) for p in range(len(words)) if abs(p - (at - key + q)) <= drift
                    )
                    for q, w in enumerate(t.words)
                ]
                whole = sum(idf[w] for w in t.words)
                score = min(1.0, sum(idf[w] for w, there in zip(t.words, stand) if there) / whole) if whole > 0 else 1.0
                if score >= least:
                    labels.add(t.label)
                    best = max(best, score)
        out.append((i, ",".join(sorted(labels)), best))
    return out
