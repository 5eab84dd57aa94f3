import random
import pytest
import re

from auditflow.llm import license_scan
from auditflow.llm.license_scan import PHRASES, Scanner, TemplateAutomaton, scan_licenses, words_of
from auditflow.llm.queries import QUERIES

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text):
    words, found = plain_words(text), []
    for phrase, label in PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_words_follow_the_pattern(spark):
    for text in ("MIT-License 2.0", "Ärger über—Öl_x", "", "a\x7fb\x00c", "日本語 text"):
        assert [w.decode() for w in words_of(text.encode())] == plain_words(text)


def test_query_matches_plain_version_on_whole_table(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op1_license_scan"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | set()
        assert 0 <= r["score"] <= 1


def test_statistics_are_longest_template_stretches():
    sequences = [[1, 2, 3, 1, 2], [2, 3, 4], [1, 2, 3, 4, 4]]
    scanner = Scanner.__new__(Scanner)
    scanner.automaton = TemplateAutomaton(sequences)
    text = [1, 2, 3, 1, 2, 3, 4, 4, 9, 3, 1, 2, 2, 3, 4, 4, 4]
    stretches = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for i, (state, length) in enumerate(scanner.statistics(text)):
        best = max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in stretches))
        assert length == best
        if length:
            ends = {(n, j - 1) for n, s in enumerate(sequences) for j in range(length, len(s) + 1) if s[j - length : j] == text[i + 1 - length : i + 1]}
            assert scanner.automaton.ends[state] == ends


def test_altered_notice_is_a_span(spark):
    mit = next(t for t, label in license_scan.TEMPLATES if label == "mit" and len(t) > 100)
    altered = "Hello world. " + mit.replace("free of charge", "gratis").replace("persons", "people") + " the end"
    rows = [(1, altered), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "licensed to drive under the bridge")]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and 0.75 <= got[1]["score"] < 1
    assert got[1]["spans"][0]["start"] == 2
    assert got[2]["labels"] == "gpl-3" and got[2]["score"] == 1
    assert got[3]["labels"] == "" and got[3]["score"] == 0 and got[3]["spans"] == []


def test_awkward_rows(awkward, no_rows):
    rows = scan_licenses(awkward).collect()
    assert len(rows) == awkward.count() and all(r["n_base"] == 0 for r in rows)
    assert scan_licenses(no_rows).count() == 0


def plain_spans(scanner, words, templates):
    """Every longest match found by trying all places of all templates, then chained template by template."""
    coded = [[scanner.ids.get(w, 0) for w in license_scan.words_of(t.encode())] for t, _ in templates]
    ids = [scanner.ids.get(w, 0) for w in words]

    def ending(i, t, place):
        n = 0
        while n <= i and n <= place and ids[i - n] == coded[t][place - n] and ids[i - n]:
            n += 1
        return n

    lengths = [{(t, p): ending(i, t, p) for t, c in enumerate(coded) for p in range(len(c))} for i in range(len(ids))]
    phrases = [[scanner.ids[w] for w in license_scan.words_of(x.encode())] for x, _ in license_scan.PHRASES]
    best = []
    for i in range(len(ids)):
        whole = [max((n for n in range(1, i + 2) if any(p[k : k + n] == ids[i - n + 1 : i + 1] for k in range(len(p)))), default=0) for p in phrases]
        best.append(max([*lengths[i].values(), *whole], default=0))
    spans = []
    for t, sequence in enumerate(coded):
        chain = None
        for i, n in enumerate(best):
            if n < scanner.min_match or (i + 1 < len(best) and best[i + 1] > n):
                continue
            places = sorted(p for p in range(len(sequence)) if lengths[i][t, p] == n)
            if not places:
                continue
            start, end = i + 1 - n, i + 1
            if chain is not None:
                first, so_far, at, covered = chain
                ahead = [p for p in places if p > at]
                if ahead and start - so_far <= scanner.max_gap:
                    new = min(ahead[0] - at, end - max(start, so_far), n)
                    if new > 0:
                        chain = (first, end, ahead[0], covered + new)
                    continue
                spans.append((t, *chain))
            chain = (start, end, places[0], n)
        if chain is not None:
            spans.append((t, *chain))
    kept = [(t, a, b, covered / len(coded[t])) for t, a, b, _, covered in spans if covered >= scanner.min_coverage * len(coded[t])]
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


@pytest.mark.parametrize("seed", range(6))
def test_chains_match_a_quadratic_version(seed):
    """Texts made of damaged templates, repeated and mixed with other words."""
    pick, templates = random.Random(seed), license_scan.TEMPLATES
    scanner = license_scan.Scanner()
    for _ in range(25):
        words = []
        for _ in range(pick.randrange(1, 4)):
            part = license_scan.words_of(pick.choice(templates)[0].encode())
            cut = pick.randrange(len(part))
            damaged = [w for w in part[: cut + 8] if pick.random() > 0.04]
            damaged.insert(pick.randrange(len(damaged) + 1), b"other")
            words += damaged + [b"noise"] * pick.randrange(15)
        got = [(s.template, s.start, s.end, s.coverage) for s in scanner.scan(words)[1]]
        assert got == plain_spans(scanner, words, templates)
