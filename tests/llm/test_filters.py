"""Operators 1, 2, 6, 7 and 9 against brute force, and their edge cases."""

import collections
import re

from tests.llm.conftest import lower, make, words_of
from textbench.llm import decontaminate, license_scan, line_quality, pii, quality_bayes


# ------------------------------------------------------------------ 1

def _normal(line):
    return tuple(re.sub("[0-9]", "0", lower(w)) for w in words_of(line))


def _expected_lines(rows, limit):
    holders, first = collections.defaultdict(set), {}
    for r in sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        for line in (r["text"] or "").split("\n"):
            k = (r["source"], _normal(line))
            if k[1]:
                holders[k].add(_normal(r["text"]))
                first.setdefault(k, r["doc_id"])
    out = {}
    for r in rows:
        text, words = r["text"] or "", words_of(r["text"])
        windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
        seen, repeated, removed = set(), 0, 0
        for line in text.split("\n"):
            if words_of(line):
                repeated += line in seen
                seen.add(line)
                k = (r["source"], _normal(line))
                if len(holders[k]) > limit and first[k] != r["doc_id"]:
                    removed += len(k[1])
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        kept = not failed and not 100 * (len(words) - removed) < 30 * len(words)
        out[r["doc_id"]] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated,
                            len(covered), failed, removed, kept)
    return out


def test_line_quality_against_brute_force(docs):
    rows = docs.collect()
    want = _expected_lines(rows, 3)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                         r["base_failed"], r["n_removed_words"], r["kept"])
           for r in line_quality.judge(docs, 3, 0.0).collect()}
    assert got == want
    assert any(v[6] for v in want.values())


def test_line_quality_keeps_rows_and_columns(docs, odd, empty):
    kept = line_quality.keep_documents(docs, 3, 0.0)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r for r in kept.collect()}
    assert sum("Shared Footer" in r["text"] for r in texts.values()) <= 3  # one of each host
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert line_quality.judge(odd).count() == odd.count()
    assert {r["doc_id"] for r in line_quality.keep_documents(odd).collect()} >= {None}
    assert line_quality.judge(empty).count() == line_quality.keep_documents(empty).count() == 0


def test_copies_of_a_text_are_not_boilerplate(spark):
    text = "one two three four five six seven eight nine ten eleven twelve\nanother line of words goes here"
    d = make(spark, [text] * 9, [i * 3 for i in range(9)])
    assert all(r["kept"] for r in line_quality.judge(d, 2, 0.0).collect())


def test_line_limit_of_small_hosts_by_default(spark, tmp_path):
    """The registered defaults remove lines and reject depleted documents of a host of 40 texts."""
    import duckdb

    from textbench.llm.oracle import ORACLE
    footer = "All 24 sections of this site are listed in the footer of each page of it"
    rows = []
    for i in range(40):
        own = " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + k) for k in range(2 if i in (30, 31) else 20))
        lines = [own] + [footer] * (i % 5 == 0 or i in (30, 31)) + ["seen in five texts only"] * (i % 8 == 1)
        rows.append((i, "\n".join(lines), "host"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r) for r in line_quality.op1_line_frequency(spark, str(tmp_path)).collect()}
    want = _expected_lines(d.collect(), 5)
    assert {i: (*r[1:7], r[8], r[7]) for i, r in got.items()} == want
    assert {i for i, r in got.items() if r[8]} == {5, 10, 15, 20, 25, 30, 31, 35}
    assert [i for i, r in got.items() if not r[7]] == [30, 31]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(db.execute(ORACLE["op1_line_frequency"]).fetchall()) == sorted(got.values())
    left = {r["doc_id"]: r["text"] for r in line_quality.keep_documents(d).collect()}
    assert [i for i, t in left.items() if footer in t] == [0] and not {30, 31} & set(left)


# ------------------------------------------------------------------ 2

def _site_rows(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 5 != 0
        toxic = i % 11 == 0
        text = " ".join(f"word{(i * 7 + k * 13) % 97}" for k in range(30))
        text += "" if good else " bad### bad### junk%%% junk%%%"
        text += " nasty insult" if toxic else ""
        rows.append((i, text, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 50 else None))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    labels += [(1, 1, None), (10**9, 1, 0), (None, 0, 0), (3, 7, -1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality_on_unlabelled_documents(spark):
    d, labels = _site_rows(spark)
    got = {r["doc_id"]: r for r in quality_bayes.score_quality(d, labels).collect()}
    held_out = [i for i in got if i % 2 == 0]
    assert sum((got[i]["quality"] >= 0.5) == (i % 5 != 0) for i in held_out) >= 0.97 * len(held_out)
    assert sum((got[i]["toxic"] >= 0.5) == (i % 11 == 0) for i in held_out) >= 0.97 * len(held_out)
    assert all(r["kept"] == (r["quality"] >= 0.5 and r["toxic"] < 0.5) for r in got.values())


def test_sparse_sites_shrink_to_their_prior(spark):
    rows = ([("big", "en", 0.9)] * 900 + [("big", "en", 0.1)] * 100 + [("bad", "en", 0.1)] * 500
            + [("bad", "en", 0.9)] * 100 + [("tiny", "en", 0.01)])
    scored = spark.createDataFrame([(*r, r[2]) for r in rows], "host string, path string, p_quality double, x double")
    sites, mean = quality_bayes.posteriors(scored, "quality")
    site = {r["host"]: r["host_quality"] for r in sites.collect()}
    assert abs(site["big"] - 0.82) < 0.05 and abs(site["bad"] - 0.233) < 0.08
    assert 0.01 < site["tiny"] < mean  # one document does not settle a site


def test_whole_posterior_against_brute_force(spark):
    import math
    import random
    r = random.Random(11)
    rows = [(i, f"h{int(r.random() ** 3 * 9)}", r.choice(["a", "a", "a", "b"]), r.uniform(0.02, 0.98), r.random() ** 2)
            for i in range(600)] + [(600, "alone", "a", 0.9, 0.1)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, p_quality double, p_toxic double")
    got = {x["doc_id"]: x for x in quality_bayes.combine(scored).collect()}
    assert len(got) == len(rows)

    def strength(sites, around):  # {site: (n, sum)}, {site: prior mean}
        n, k = sum(x[0] for x in sites.values()), len(sites)
        gap = sum(c * (s / c - around[i]) ** 2 for i, (c, s) in sites.items())
        m = sum(s for _, s in sites.values()) / n
        own = max((gap - (k - 1) * m * (1 - m)) / (n - sum(c * c for c, _ in sites.values()) / n), 1e-6)
        return min(max(m * (1 - m) / own - 1, 1.0), 1e4)

    logit = lambda p: math.log(p / (1 - p))
    for column, target in ((3, "quality"), (4, "toxic")):
        hosts, paths = {}, {}
        for x in rows:
            for sites, key in ((hosts, x[1]), (paths, x[1:3])):
                c, s = sites.get(key, (0, 0.0))
                sites[key] = (c + 1, s + x[column])
        mean = sum(x[column] for x in rows) / len(rows)
        a = strength(hosts, dict.fromkeys(hosts, mean))
        post = {h: (a * mean + s) / (a + c) for h, (c, s) in hosts.items()}
        b = strength(paths, {k: post[k[0]] for k in paths})
        for x in rows:
            p, (hn, hs), (pn, ps) = x[column], hosts[x[1]], paths[x[1:3]]
            others = (a * mean + hs - p) / (a + hn - 1)
            others = (b * others + ps - p) / (b + pn - 1)
            want = 1 / (1 + math.exp(-(logit(p) + logit(others) - logit(mean))))
            assert abs(got[x[0]][target] - want) < 1e-9
            assert abs(got[x[0]][f"path_{target}"] - (b * post[x[1]] + ps) / (b + pn)) < 1e-9
    assert abs(got[600]["quality"] - 0.9) < 1e-9  # alone on its site: its own evidence, once


def test_hot_and_small_sites_are_joined_apart(spark):
    """Sites on both sides of the bound of shipped sites."""
    rows = ([(i, "hot", "x", 0.4, 0.2) for i in range(1500)] + [(1500 + i, f"s{i}", "x", 0.6, 0.2) for i in range(1500)]
            + [(3000, "", "", 0.5, 0.5)])
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, p_quality double, p_toxic double")
    got = quality_bayes.combine(scored).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3001))


def test_site_of_a_url(spark):
    urls = ["https://News.example.org/sports/a/b.html", "http://example.com/page.html", "http://example.com", "no url", None]
    host, path = quality_bayes.url_site("url")
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(host, path).collect()
    assert [tuple(r) for r in got] == [("news.example.org", "sports"), ("example.com", ""), ("example.com", ""),
                                       (None, ""), (None, "")]


def test_quality_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_bayes.score_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["quality"] <= 1 for r in got)
    assert quality_bayes.score_quality(odd, labels.limit(0)).count() == odd.count()
    assert quality_bayes.score_quality(empty, labels).count() == 0


# ------------------------------------------------------------------ 6

def _dice(a, b):
    def grams(s):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", s.lower())
        return set(zip(w, w[1:]))
    a, b = grams(a), grams(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_license_scan_against_brute_force(spark):
    lines = [t for _, t in license_scan.TEMPLATES if "\n" not in t]
    texts = [f"some words\n{t}\nmore words of it" for t in lines]
    texts += [lines[3].replace("MIT", "mit,"), "Licensed under CC BY-NC 4.0", "licensed under something else", "MIT"]
    d = make(spark, texts)
    got = {}
    for r in license_scan.scan_licenses(d).where("unit != 'text' AND unit != 'paragraph' OR first_word = 0").collect():
        got.setdefault(r["doc_id"], []).append((r["license"], round(r["dice"], 9)))
    for i, text in enumerate(texts):
        for line in text.split("\n"):
            best = max(_dice(line, t) for _, t in license_scan.TEMPLATES)
            if best >= license_scan.THRESHOLD:
                assert any(abs(dice - best) < 1e-6 for _, dice in got[i]), line
    assert 3 + len(lines) not in got


def test_license_scan_whole_text_and_edges(spark, docs, odd, empty):
    mit = license_scan.TEMPLATES[1][1]
    (r,) = license_scan.scan_licenses(make(spark, [mit.upper()])).where("unit != 'line'").collect()
    assert r["license"] == "MIT" and r["dice"] == 1.0
    assert license_scan.scan_licenses(docs).count() == license_scan.scan_licenses(odd).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0
    assert license_scan.scan_licenses(make(spark, ["All rights reserved."]), []).count() == 0


def _best_windows(text, templates, threshold):
    """All windows of a text, by the rule as stated."""
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    w, found = split(text), []
    for k, (name, body) in enumerate(sorted(set(templates))):
        t = split(body)
        grams = set(zip(t, t[1:]))
        for i in range(len(w) - 1):
            if (w[i], w[i + 1]) in grams:
                part = w[i:i + len(t)]
                own = set(zip(part, part[1:]))
                dice = 2 * len(own & grams) / (len(own) + len(grams))
                if dice >= threshold:
                    found.append((-len(own & grams), -dice, i, k, name, i + len(part)))
    free, out = set(range(len(w))), []
    for _, dice, i, _, name, end in sorted(found):
        if set(range(i, end)) <= free:
            free -= set(range(i, end))
            out.append((i, end, name, round(-dice, 9)))
    return sorted(out)


def test_license_notices_inside_longer_units(spark):
    texts = ["Copyright (c) 2020 Example Corp. All rights reserved.",
             "Code here. Released under the MIT License. See file.",
             " ".join(f"before{i}" for i in range(300)) + " " + license_scan.TEMPLATES[1][1].replace("sublicense", "rent").replace("\n", " * ")
             + "".join(f" after{i}" for i in range(300)),
             "what is released under the sea, the software and the license of it, is reserved for all"]
    got = {}
    for r in license_scan.scan_licenses(make(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["first_word"], r["end_word"], r["license"], round(r["dice"], 9), r["unit"]))
    assert got[0] == [(5, 8, "All-Rights-Reserved", 1.0, "window")]
    assert got[1] == [(2, 7, "MIT", 1.0, "window")]
    assert [x[2] for x in got[2]] == ["MIT"] and 3 not in got
    for i, text in enumerate(texts):
        assert [x[:4] for x in got.get(i, [])] == _best_windows(text, license_scan.TEMPLATES, license_scan.THRESHOLD)


def test_license_windows_against_brute_force(spark):
    import random
    r = random.Random(5)
    templates = [("a", "x y z u v x y"), ("b", "y z u"), ("b", "u v w x"), ("c", "x x y"), ("d", "lone")]
    texts = [" ".join(r.choice("xyzuvw") for _ in range(r.randint(0, 60))) for _ in range(150)]
    units = license_scan.scan_licenses(make(spark, texts), templates, 0.6).collect()
    whole = {x["doc_id"] for x in units if x["unit"] != "window"}
    got = {}
    for x in units:
        got.setdefault(x["doc_id"], []).append((x["first_word"], x["end_word"], x["license"], round(x["dice"], 9)))
    left = [i for i in range(len(texts)) if i not in whole]
    assert len(left) > 100 and len(got) > 50
    for i in left:
        assert got.get(i, []) == _best_windows(texts[i], templates, 0.6)


# ------------------------------------------------------------------ 7

ITEMS = [(1, "Janet has 16 ducks that lay eggs and she sells Robert each of 16 eggs for 3 dollars every day"),
         (2, "tiny item here"), (3, None), (4, ""), (1, "Janet has 16 ducks that lay eggs and she sells Robert each of "
                                                       "16 eggs for 3 dollars every day")]


def _bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_finds_copies_and_new_parameters(spark):
    d = make(spark, [
        "before it. " + ITEMS[0][1] + " and after",
        "ok so janet has 21 ducks that lay eggs and she sells Maria each of 21 eggs for 7 dollars every day yes",
        "janet has 21 ducks that lay eggs and she sells Maria each of 99 eggs for 7 dollars every day",
        "a tiny item here indeed", "16 16 16 16 16 16 16 16 16", None, "", "nothing of the kind in this text at all"])
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.contaminated_pairs(d, _bench(spark)).collect()}
    assert got == {(0, 1): True, (1, 1): False, (3, 2): True}
    left = decontaminate.drop_contaminated(d, _bench(spark))
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {2, 4, 5, 6, 7}


def test_decontamination_finds_verbatim_copies_with_few_literals(spark, monkeypatch):
    items = ["What is 17 times 23?", "Who wrote Hamlet?", "Add 3 4 5 6 7 8 9 10 11 12 and then 13 14 15 16",
             "is Paris or Rome bigger", "Please tell every one of the good readers here about 1 2 3 4 5 6 7"]
    bench = _bench(spark, list(enumerate(items)))
    d = make(spark, [f"first a line. {t} and on" for t in items]
             + ["What is 18 times 23?", "who wrote Macbeth?", "Add 3 4 5 6 9 9 9 10 1 1 and then 13 14 15 1",
                "so please tell every one of the good readers here about 9 8 7 6 5 4 3"])
    want = {(i, i): True for i in range(5)} | {(8, 4): False}
    for shipped in (decontaminate.MOST_SHIPPED, 1):
        monkeypatch.setattr(decontaminate, "MOST_SHIPPED", shipped)
        got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.contaminated_pairs(d, bench).collect()}
        assert got == want


def test_decontamination_is_independent_of_sentence_and_line_starts(spark, monkeypatch):
    item = ("Janet has 16 ducks at home. Robert sells 3 of them to Maria today. Oscar buys 4 more ducks from Janet. "
            "Susan keeps 9 of the rest")
    names = {"Janet": "Helga", "Robert": "Pedro", "Maria": "Greta", "Oscar": "Niels", "Susan": "Linda"}
    other = re.sub("|".join(names), lambda m: names[m[0]], item)
    words = item.split()
    d = make(spark, [item, other, "\n".join(" ".join(words[i:i + 2]) for i in range(0, len(words), 2)),
                     "as asked Janet has 16 ducks at home. " + item.split(". ", 1)[1].lower(),
                     # the second Janet is another than the first, at a sentence start
                     "She" + item[5:], other.replace("from Helga", "from Wilma")])
    for shipped in (decontaminate.MOST_SHIPPED, 1):
        monkeypatch.setattr(decontaminate, "MOST_SHIPPED", shipped)
        got = {r["doc_id"]: (r["cover"], r["exact"])
               for r in decontaminate.contaminated_pairs(d, _bench(spark, [(1, item)])).collect()}
        assert got[0] == (1.0, True) and got[1] == (1.0, False) and got[2] == (1.0, True)
        assert got[4][0] >= 0.5 and 5 not in got


def test_decontamination_without_shipped_hashes_is_the_same(spark, docs, monkeypatch):
    bench = _bench(spark, [(9, " ".join(words_of(docs.where("doc_id = 4").first()["text"])))])
    some = sorted(map(tuple, decontaminate.contaminated_pairs(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MOST_SHIPPED", 1)
    assert sorted(map(tuple, decontaminate.contaminated_pairs(docs, bench).collect())) == some
    assert 4 in {r[0] for r in some}


def test_decontamination_edges(spark, odd, empty):
    assert decontaminate.contaminated_pairs(empty, _bench(spark)).count() == 0
    assert decontaminate.contaminated_pairs(odd, _bench(spark).limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, _bench(spark)).count() == odd.count()


# ------------------------------------------------------------------ 9

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PRIVATE = ["a@b@c.com x@y..z q@r.s_t@u.v aa_bb@cc.dd_ee@ff.gg", "1.2.3.4.5 256.1.1.1 0001.02.3.255 1.2.3 9999.1.1.1",
           "4111 1111 1111 1111 and 4111-1111-1111-1111, 41111111111111111 4111111111111112",
           "+1 (988) 555-2485. +49 30 1234567 ++1 2 3 4 5 6 7 8 +1- +123", "é𝒳é a.b+c@d-e.f.g 10.0.0.1",
           "@@@@ a@ @b.c %+@x.y.z" * 50, "1" * 3000 + " " + "a" * 3000 + "@", "1 " * 3000, "a@b.c" + ".d" * 3000]


def _luhn(s):
    t = [int(c) for c in reversed(s)]
    return sum(t[::2] + [sum(divmod(2 * d, 10)) for d in t[1::2]]) % 10 == 0


def _valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def test_personal_data_against_re(spark, docs):
    d = make(spark, PRIVATE).unionByName(docs)
    for r in pii.find_personal_data(d).collect():
        if r["doc_id"] >= len(PRIVATE):
            continue
    got = {r["doc_id"]: [tuple(s)[:3] for s in r["spans"]] for r in pii.find_personal_data(make(spark, PRIVATE)).collect()}
    for i, text in enumerate(PRIVATE):
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if _valid(k, m[0])]
        assert [s for s in got[i] if s[0] in BASE] == want


def test_personal_data_further_kinds_need_checks_and_context(spark):
    d = make(spark, ["IBAN DE89370400440532013000, GB82 WEST 1234 5698 7654 32 but DE89370400440532013001",
                     "my ssn 123-45-6789", "number 123-45-6789 of the catalogue",
                     "amex card 378282246310005", "part 378282246310005", "tel (212) 555-1234", "code (212) 555-1234"])
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_personal_data(d).collect()}
    assert kinds == {0: ["iban", "iban"], 1: ["ssn"], 2: [], 3: ["short_card"], 4: [], 5: ["local_phone"], 6: []}


def test_personal_data_masks_and_edges(spark, odd, empty):
    d = make(spark, ["write to a@b.com or +1 (988) 555-2485 now", "nothing", None])
    got = {r["doc_id"]: r for r in pii.mask_personal_data(d).collect()}
    assert got[0]["text"] == "write to <EMAIL> or <PHONE> now" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == "nothing" and got[2]["text"] is None
    assert pii.mask_personal_data(d).columns == d.columns
    assert pii.find_personal_data(odd).count() == odd.count()
    assert pii.mask_personal_data(empty).count() == 0


def test_personal_data_runs_no_python(docs):
    plan = pii.mask_personal_data(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
