import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from barloom.llm import decontaminate, licenses, pii, urlfilter
from tests.llm.helpers import nothing, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items):
    w, hit, found = words(text), set(), set()
    for item, other in items:
        b = words(other)
        k = min(13, len(b))
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1 if b else 0):
            if tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(7, "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"), (10, "short item, here"), (2, "short ITEM"), (3, ""), (4, None), (5, "é É")]


def test_contamination_against_brute_force(spark):
    passage = ITEMS[0][1]
    far = " ".join(f"w{k}" for k in range(4000))
    docs = odd_docs(spark, passage, "x " + passage.replace(" ", " -- ").upper() + " y", passage[6:], f"{far} {passage} {far}", "a short item, here and short item here", "É é É", "nu xi")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted(((r["doc_id"], *brute_contamination(r["text"], ITEMS)) for r in docs.collect()), key=str)
    # All windows are few, those that documents hold are, none are.
    absent = spark.createDataFrame([(99, " ".join(f"never{k}" for k in range(60)))], benchmark.schema)
    for limit in (400_000, 20, 0):
        judged = decontaminate.judge(docs.select("doc_id", "text"), benchmark.unionByName(absent), limit).where("n_hit > 0").select("n_words", "n_hit", F.size("items"))
        assert sorted(map(tuple, judged.collect())) == sorted(e[1:4] for e in expected if e[2])
    found = sorted((tuple(r) for r in decontaminate.contamination_digests(docs, benchmark).collect()), key=str)
    assert found == expected
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not e[-1] for e in expected)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs.where("doc_id IN (1, 3)"), benchmark, "spans").collect()}
    assert cut[1].split() == ["x", "y"] and cut[3].split() == (far + " " + far).split()
    whole = decontaminate.decontaminate(docs, benchmark.limit(0), "spans")
    assert whole.exceptAll(docs).isEmpty() and docs.exceptAll(whole).isEmpty()
    assert decontaminate.decontaminate(docs, benchmark, "spans").where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert not decontaminate.contamination_digests(docs, benchmark.limit(0)).where("n_hit > 0").count()
    assert decontaminate.contamination_digests(nothing(spark), benchmark).collect() == []


def test_pieces_are_whole_for_words_longer_than_a_piece(spark):
    text = f"{'x' * 40000} alpha beta {'y' * 17000} gamma {'z' * 16384} delta"
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, text string")
    r = decontaminate.contamination_digests(docs, bench).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (7, 7, True)


def test_licenses_against_exact_containment(spark):
    mit = licenses.TEMPLATES["mit-permission"]
    changed = mit.replace("publish, distribute", "publicise, spread")
    far = " ".join(f"filler{k}" for k in range(500))
    docs = odd_docs(spark, f"{far} {mit} {far}", f"{far} {changed}", "Released under the MIT License.", "released UNDER the mit licence", licenses.TEMPLATES["gpl-3.0-line"] + "\n" + licenses.TEMPLATES["apache-2.0-line"], mit[: len(mit) // 2])
    found = {r["doc_id"]: r["licenses"] for r in licenses.license_digests(docs.where("doc_id IS NOT NULL AND doc_id < 9 AND text NOT LIKE 'another%'")).collect()}
    assert found[0] == found[1] == "mit-permission" and found[2] == "mit-line" and found[3] == "" and found[4] == "apache-2.0-line,gpl-3.0-line" and found[5] == ""
    assert licenses.license_digests(docs).count() == docs.count()
    assert licenses.license_digests(nothing(spark)).collect() == []


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(11)
    alphabet = ["a", "b.", "@", "x@y.z", "_", "é", "1", "25", ".", "4111 1111 1111 1111", "+1 (614) 555-8001", "10.0.0.255", "256.1.1.1", " ", "-", "+", "%", "@@", ".com", "00", "😀"]
    for _ in range(6000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 12)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_digests_and_sanitising(spark):
    docs = odd_docs(spark, "é mail to a.b@c.de now", "call +1 (614) 555-8001 or 10.0.0.1", "card 4111-1111-1111-1111 x")
    rows = pii.pii_digests(docs).collect()
    assert len(rows) == docs.count()
    by = {r["spans"]: r for r in rows}
    assert "email:10:18" in by[next(s for s in by if s.startswith("email"))]["spans"]
    base = "email:10:18"
    assert next(r for r in rows if r["n_email"] == 1)["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert pii.pii_digests(nothing(spark)).collect() == []
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r["text"] for r in clean.collect()}
    assert {"é mail to [EMAIL] now", "call [PHONE] or [IP]", "card [CARD] x", None, ""} <= texts


def brute_secrets(text):
    base = brute_spans(text)
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        changes = sum(a.isdigit() != b.isdigit() and (a + b).isalnum() for a, b in zip(m[0], m[0][1:]))
        bits = sum(-n * math.log2(n / len(m[0])) for n in Counter(m[0]).values())
        if changes >= 4 and bits >= 64 and all(m.end() <= x or y <= m.start() for _, x, y in base):
            yield ("secret", *m.span())


def brute_terms(texts):
    """Risky terms, each with the kind that it is generalised to (empty: removed), and term spans of each text, counted word by word over all texts."""
    near, about, total = Counter(), Counter(), Counter()
    contexts, parsed = {}, []
    for text in texts:
        text = text or ""
        spans = [*brute_spans(text), *brute_secrets(text)]
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
        lower = [words(m[0])[0] for m in found]
        free = [all(m.end() <= a or b <= m.start() for _, a, b in spans) for m in found]
        total.update(lower)
        parsed.append((found, lower, free))
        told = {}
        for kind, a, b in spans:
            value = text[a:b].lower() if kind == "email" else text[a:b] if kind in ("ip", "secret") else re.sub("[^0-9]", "", text[a:b])
            before, after = [k for k, m in enumerate(found) if m.end() <= a], [k for k, m in enumerate(found) if m.start() >= b]
            around = [k for k in before[-6:] + after[:6] if free[k]]
            fresh = [k for k in around if k not in told.setdefault(kind, set())]
            told[kind].update(fresh)
            for subject, context, own in (((kind, value), tuple(lower[k] for k in around), around), ((kind,), value, fresh)):
                about[subject] += len(own)
                for k in own:
                    near[lower[k], subject] += 1
                    contexts.setdefault((lower[k], subject), set()).add(context)
    n, bits = sum(total.values()), {}
    for (word, subject), times in near.items():
        usual = about[subject] / n
        share = (min(times, total[word]) + usual) / (total[word] + 1)
        if len(contexts[word, subject]) >= 3 and share >= 0.75 and math.log2(share / usual) >= (8 if len(subject) == 2 else 6):
            bits.setdefault(word, []).append((len(subject) == 1, -math.log2(share / usual), subject[0]))
    risky = {word: min(b)[2] if min(b)[0] else "" for word, b in bits.items()}
    return risky, [[m.span() for m, w, f in zip(found, lower, free) if f and w in risky] for found, lower, free in parsed]


def test_terms_that_reveal_an_entity_are_found(spark):
    rng = random.Random(21)
    noise = lambda: " ".join(rng.choice(["the", "of", "and", "é", f"n{rng.randrange(4000)}"]) for _ in range(60))
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    texts = [noise() for _ in range(900)]
    texts += [f"{noise()} Zorblax writes from zed@corp.example daily {noise()}" for _ in range(6)]
    texts += [f'{noise()} passkey = "{key()}" {noise()}' for _ in range(8)] + [f"{noise()} pw{k} {key()} pw{k}" for k in range(3)]
    texts += [f"{noise()} call +1 (614) 555-80{k:02d} the {noise()}" for k in range(5)] + [None, "", "passkey alone is found too, Zorblax also"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    risky, spans = brute_terms(texts)
    assert risky["zorblax"] == "" and risky["passkey"] == "secret" and not set(risky) & {"the", "of", "pw1"}
    rows = {r["doc_id"]: r for r in pii.pii_digests(docs).collect()}
    for k, text in enumerate(texts):
        every = [*brute_spans(text or ""), *brute_secrets(text or ""), *(("term", *s) for s in spans[k])]
        assert rows[k]["spans"] == ",".join(f"{x}:{a}:{b}" for x, a, b in every), text
        assert rows[k]["n_spans"] == len(every) and rows[k]["n_term"] == len(spans[k])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[len(texts) - 1].startswith("[SECRET-TERM] alone is found too, ") and "zed@" not in clean[900] and "orblax" not in clean[900]
    assert '[SECRET-TERM] = "[SECRET]"' in clean[906]
    copies = spark.createDataFrame([(k, texts[900]) for k in range(50)], "doc_id long, text string")
    assert pii.risky_terms(copies, bits=0.0, kind_bits=0.0).count() == 0
    # More terms than a pass holds are found in passes, with the same spans.
    terms = pii.term_codes(pii.risky_terms(docs))
    once = {r["doc_id"]: r["terms"] for r in pii.mark_terms(docs, terms).collect()}
    held, pii.TERMS_PER_PASS = pii.TERMS_PER_PASS, 1
    try:
        assert {r["doc_id"]: r["terms"] for r in pii.mark_terms(docs, terms).collect()} == once
    finally:
        pii.TERMS_PER_PASS = held


def test_url_rules_and_verdicts(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "STEPS", 8)
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">t</a>' for h in hosts)
    pages = [
        (1, "http://A.example.NET/en/1?x", link("b.org")), (2, "https://a.example.net/de/1", ""), (3, "https://example.com/de/x#y", None), (4, "https://xexample.com/de/x", ""),
        (5, "http://b.org/fr/", link("c.org", "c.org")), (6, "http://b.org", ""), (7, None, link("bad.net")), (8, "no url", ""), (9, "x://bad.net/", ""), (10, "http://liar.org/p", link("bad.net")),
        (11, "http://c.org/p", ""), (11, "http://c.org/p", ""), (12, "http://b.org/fr/2", ""),
    ]
    frame = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, rule string")
    found = {}
    rows = urlfilter.filter_urls(frame).collect()
    for r in rows:
        found.setdefault(r["page_id"], r)
    assert len(rows) == len(pages)
    assert [found[k]["rule"] for k in range(1, 11)] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, "net/", None]
    assert (found[1]["host"], found[1]["path"], found[6]["path"], found[7]["host"]) == ("a.example.net", "/en/1", "", "")
    assert [found[k]["verdict"] for k in (1, 2, 3, 5, 9)] == ["allow", "block", "block", "allow", "block"]
    assert found[11]["verdict"] == "allow" and found[4]["verdict"] == "allow" and found[7]["verdict"] == "allow"
    assert urlfilter.filter_urls(frame.limit(0)).collect() == []


def test_propagation_is_personalised_pagerank(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "STEPS", 24)
    arcs = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 1, ("d", "c"): 5}
    edges = spark.createDataFrame([(*k, n) for k, n in arcs.items()], "src string, dst string, n long")
    start = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0), ("e", 0.5, 0.0)], "host string, trust double, distrust double")
    found = {r["host"]: (r["trust"], r["distrust"]) for r in urlfilter.propagate(edges, start).collect()}
    for kind, (seed, table) in enumerate((({"a": 1.0}, arcs), ({"c": 1.0}, {(d, s): n for (s, d), n in arcs.items()}))):
        score = dict.fromkeys("abcd", 0.0) | seed
        for _ in range(urlfilter.STEPS):
            out = {h: sum(n for (s, _), n in table.items() if s == h) for h in "abcd"}
            score = {h: 0.15 * seed.get(h, 0.0) + 0.85 * sum(score[s] * n / out[s] for (s, d), n in table.items() if d == h) for h in "abcd"}
        for h in "abcd":
            assert abs(found[h][kind] - score[h]) < 1e-9
    assert abs(found["e"][0] - 0.075) < 1e-12
    alone = {r["host"]: r["trust"] for r in urlfilter.propagate(edges.limit(0), start).collect()}
    assert alone == {"a": 1 - 0.85, "c": 0.0, "e": 0.5 * (1 - 0.85)}


def linked_pages():
    """Urls of pages and the hosts that they name: t and u, and n and v, link to each other alone, so scores swing and settle slowly."""
    links = {"t.org/fr": ["u.com"], "u.com": ["t.org"], "n.net": ["v.com"], "v.com": ["n.net"], "w.com": ["n.net", "N.net", "n2.net", "s.com"], "s.com": ["u.com", "t.org"], "r.com": ["w.com"], "n2.net": []}
    pages = [(k, f"http://{page}/{k}", "".join(f"<a href='//{h}/'>" for h in out) + '<a href="/own">') for k, (page, out) in enumerate(links.items())]
    # Mixed hosts: a section is blocked, the rest has no rule.
    pages += [(20 + k, f"https://mixed.example.com/{'de' if k < 5 else 'en'}/{k}", "see http://mixed.example.com/x, //no.link and https://t.org") for k in range(6)]
    pages += [(40 + k, f"https://mild.example.com/{'de' if k < 1 else 'en'}/{k}", '<script src="https://cdn.com/a.js"></script>') for k in range(6)]
    return pages + [(60, None, None), (61, "no url", "<img src=http://v.com/i.png>")]


def test_verdicts_of_a_linked_graph_against_brute_force_and_sql(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(urlfilter, "STEPS", 16)
    pages = linked_pages()
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    host = lambda url: re.sub("[A-Z]", lambda m: m[0].lower(), re.search("://([^/?#]*)", url)[1]) if url and "://" in url else ""
    rows, arcs, hosts = urlfilter.filter_urls(frame).collect(), Counter(), sorted({host(u) for _, u, _ in pages})
    ruled = {r["page_id"]: r["verdict"] for r in rows if r["rule"]}
    for _, url, html in pages:
        named = set(re.findall(r"(?i)(?:[a-z]+:|=[\"']?)//([^/\"'\s<>]+)", html or ""))
        arcs.update((host(url), h.lower()) for h in named if h.lower() != host(url))
    every = sorted({*hosts, *(h for arc in arcs for h in arc)})
    own = {h: [ruled.get(k) for k, u, _ in pages if host(u) == h] for h in hosts}
    trust = {h: sum(1.0 if v == "allow" else 0.5 if v is None else 0.0 for v in own[h]) / len(own[h]) if h in own else 0.0 for h in every}
    distrust = {h: sum(v == "block" for v in own[h]) / len(own[h]) if h in own else 0.0 for h in every}

    def rank(seed, arcs):
        score, out = dict(seed), Counter()
        for (a, _), n in arcs.items():
            out[a] += n
        for _ in range(urlfilter.STEPS):
            score = {h: 0.15 * seed[h] + 0.85 * sum(score[a] * n / out[a] for (a, to), n in arcs.items() if to == h) for h in every}
        return score

    trust, distrust = rank(trust, arcs), rank(distrust, Counter({(b, a): n for (a, b), n in arcs.items()}))
    found = {r["host"]: r for r in urlfilter.host_verdicts(frame).collect()}
    assert sorted(found) == hosts
    for h in hosts:
        assert abs(found[h]["trust"] - trust[h]) < 1e-9 and abs(found[h]["distrust"] - distrust[h]) < 1e-9, h
        assert found[h]["verdict"] == ("block" if distrust[h] > 0 and distrust[h] >= trust[h] else "allow"), h
    for r in rows:
        assert r["verdict"] == ruled.get(r["page_id"], found[r["host"]]["verdict"])
    own = {r["host"]: r["verdict"] for r in rows if not r["rule"]}
    assert (own["r.com"], own["w.com"], own["mixed.example.com"]) == ("block",) * 3 and (own["s.com"], own["u.com"], own["mild.example.com"]) == ("allow",) * 3
    con = duckdb.connect()
    con.register("pages", frame.toArrow())
    assert sorted(map(str, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urlfilter.ORACLE_SQL['op8_url_filters']})").fetchall())) == sorted(str(tuple(r)) for r in rows)
    # Blocked hosts beyond the broadcast give the same verdicts.
    monkeypatch.setattr(urlfilter, "STEPS", 4)
    few = sorted(map(str, urlfilter.filter_urls(frame).collect()))
    monkeypatch.setattr(urlfilter, "BROADCAST_HOSTS", 0)
    assert sorted(map(str, urlfilter.filter_urls(frame).collect())) == few


def test_hot_keys_are_joined_like_others(spark):
    from barloom.llm.common import join_by_weight

    rows = spark.range(5000).selectExpr("id", "IF(id < 3000, 0, id) AS k")
    keys = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert join_by_weight(rows, keys, ["k"], "n", 5000).where("n = IF(k = 0, 3000, 1)").count() == 5000
