import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from zymolith.llm import surrogates as P

KEY = b"test key"


def test_permutations_are_one_to_one():
    for letters, n in (("0123456789", 1), ("0123456789", 3), ("01", 8), ("abcdefghijklmnopqrstuvwxyz", 2)):
        from itertools import product

        every = ["".join(x) for x in product(letters, repeat=n)]
        assert sorted(P._permuted(KEY, "t", letters, x) for x in every) == sorted(every)


def test_formats_are_kept():
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
    for kind, text in (("email", "Jo.Doe34@mail7.Example.com"), ("phone", "+1 (017) 555-7713"), ("card", "9807-9157-6280-4490"), ("ssn", "123-45-6789"), ("iban", "DE44 5001 0517 5407 3249 31")):
        new = P.surrogate(kind, text, KEY)
        assert shape(new) == shape(text) and new != text
    assert P.surrogate("email", "a@b.example.org", KEY).endswith(".org")
    for digits in ("4539578763621486", "4539578763621487"):
        assert P._luhn(P.surrogate("card", digits, KEY)) == P._luhn(digits)
    assert all(0 <= int(x) < 256 for x in P.surrogate("ip", "255.1.20.3", KEY).split("."))


def test_gender_script_and_coreference():
    for (gender, script), names in P.NAMES.items():
        new = [P.surrogate("name", n, KEY) for n in names]
        assert sorted(new) == sorted(names) and all(a != b for a, b in zip(names, new, strict=True)), (gender, script)
    new = P.surrogate("name", "Anna Müller", KEY)
    assert new.split()[0] in P.NAMES["female", "latin"] and new.split()[1][0].isupper() and new.split()[1] != "Müller"
    a, b = P.surrogate("phone", "+1 (017) 555-7713", KEY), P.surrogate("phone", "+1 017 555 7713", KEY)
    assert P.normal("phone", a) == P.normal("phone", b)
    assert P.normal("email", P.surrogate("email", "A.B@C.com", KEY)) == P.normal("email", P.surrogate("email", "a.b@c.com", KEY))


def test_mentions():
    texts = ["mail und.34@mail7.example.com geiever.", "ip 97.51.17.173. 300.1.1.1 1.2.3.4.5", "+1 (826) 555-4081 190.137.223.204 du", "x 1232810148878564 y", "Anna Müller and Hannahx", None, "", "no"]
    got = {d: [(k, t) for k, _, _, t in m] for d, m in P.mentions(pa.array(texts).fill_null(""))}
    assert got == {
        0: [("email", "und.34@mail7.example.com")],
        1: [("ip", "97.51.17.173")],
        2: [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")],
        3: [("card", "1232810148878564")],
        4: [("name", "Anna Müller")],
    }


def test_names_beside_any_punctuation():
    """Texts whose names stand only beside marks outside ASCII, or beside none at all."""
    texts = ["Anna’s letter", "“Anna Smith”", "«Иван Петров»", "wait—Peter Jones", "von\u00a0Maria\u00a0da", "…Olga, Ольга…", "Paul、Hans", "„Klaus‟", "éAnna Иванка Peterß John_ 3Paul", "Annaé", "_Мария", "Carmen\u200b"]
    texts += [f"{a}{n}{b}" for n in ("Anna", "Иван") for a in " ’“«—\u00a0éя_a1" for b in " ’”»–\u2003üж_b2"]
    want = {d: [m[0] for m in P._FULL.finditer(t) if m.lastgroup == "name"] for d, t in enumerate(texts)}
    want = {d: m for d, m in want.items() if m}
    got = {d: [t for k, _, _, t in m if k == "name"] for d, m in P.mentions(pa.array(texts))}
    assert got == want and {0, 1, 2, 3, 4, 5, 6, 7} <= set(got)


def test_texts_are_replaced_whole_and_alike(spark):
    mail = "jane.roe@example.org"
    rows = [(1, f"write {mail} now"), (2, f"x {mail.upper()} " + "w " * 60_000 + mail), (3, None), (None, mail), (5, "nothing"), (5, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_email", F.lit("clash")).repartition(3)
    got = P.replace_personal_data(docs, KEY).collect()
    new = next(r.text for r in got if r.doc_id is None)
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and new != mail and by[1].text == f"write {new} now" and by[3].text == "" and by[5].text == "nothing"
    assert by[2].text == f"x {new.upper()[:-3]}ORG " + "w " * 60_000 + new and by[2].n_email == 2
    assert P.replace_personal_data(docs.limit(0), KEY).count() == 0


def test_surrogates_are_no_entities_and_distinct(spark):
    """All 100 two-digit endings of a number: every first surrogate is another entity, or the last free one."""
    real = [f"123-45-{k:04d}" for k in range(0, 10000, 2)]
    rows = [("ssn", P.normal("ssn", x)) for x in real]
    table = spark.createDataFrame([(k, n, P.normal(k, P.surrogate(k, n, P_KEY))) for k, n in rows] + [("ssn", f"{n:09d}", f"{(n * 7) % 1000:09d}") for n in range(500)], "kind string, norm string, surrogate string")
    odd = {(r.kind, r.norm): r.attempt for r in P.entity_attempts(table, P_KEY).collect()}
    norms = {r.norm for r in table.collect()}
    final = {}
    for r in table.collect():
        a = odd.get((r.kind, r.norm), 0)
        final[r.norm] = r.surrogate if not a else P.normal("ssn", P.surrogate("ssn", r.norm, P_KEY, a))
    assert odd and len(set(final.values())) == len(final) and not set(final.values()) & norms


def test_crowded_formats_keep_the_permutation(spark):
    """More than half of a group's names alone, and all emails of one letter a part: nothing fails, no two agree, none is its own."""
    women, men = P.NAMES["female", "latin"], P.NAMES["male", "cyrillic"]
    real = [("given", n) for n in women[:13] + men[:3]] + [("family", "Smith"), ("email", "ab@cde.org")]
    real += [("email", f"{a}@{b}.com") for a in P.ALPHABETS[1] for b in P.ALPHABETS[1]]
    rows = [(k, n, P.normal(k, P.surrogate(k, n, P_KEY))) for k, n in real]
    odd = {(r.kind, r.norm): r.attempt for r in P.entity_attempts(spark.createDataFrame(rows, "kind string, norm string, surrogate string"), P_KEY, 2).collect()}
    final = {(k, n): P.normal(k, P.surrogate(k, n, P_KEY, odd.get((k, n), 0))) for k, n in real}
    assert len({(k, s) for (k, _), s in final.items()}) == len(real)
    assert all(s != n for (_, n), s in final.items())
    assert not {final["given", n] for n in men[:3]} & set(men[:3])  # these have free names
    docs = spark.createDataFrame([(k, f"{n}, said") for k, n in enumerate(women)], "doc_id long, text string")
    out = {r.doc_id: r.text.split(",")[0] for r in P.replace_personal_data(docs, KEY).collect()}
    assert sorted(out.values()) == sorted(women) and all(out[k] != n for k, n in enumerate(women))


P_KEY = b"another key"


def test_persons_by_context_and_coreference(spark):
    texts = {
        1: "Anna Müller met Bob Stone and Wei Chen. Later Anna left; Ms Müller stayed with Stone.",
        2: "Dear all, my name is Ricarda Huch. Kind regards,\nRicarda",
        3: "Herr Müller und Frau Dr. Weiß sahen New York.",
        4: "Call 030 1234567 or 0171-5550199, room 0123, on 01/02/2024.",
        5: "Stone walls and a chen.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    out = {r.doc_id: r for r in P.replace_personal_data(docs, KEY).collect()}
    a = out[1].text.replace(".", "").replace(";", "").split()
    assert [out[k].n_name for k in (1, 2, 3, 5)] == [6, 2, 2, 0] and out[5].text == texts[5]
    given, family = a[0], a[1]
    assert given in P.NAMES["female", "latin"] and a[9] == given and a[12] == family and a[15] == a[4] != "Stone"
    assert not {"Anna", "Müller", "Bob", "Stone", "Wei", "Chen"} & set(a) and len({family, a[4], a[7]}) == 3
    assert out[3].text.split()[1] == family and out[3].text.endswith("sahen New York.") and "Weiß" not in out[3].text
    assert out[2].text.split()[5] == out[2].text.split("\n")[1] != "Ricarda"
    assert out[4].n_phone == 2 and out[4].text.endswith(", room 0123, on 01/02/2024.") and out[4].text[5:16].replace(" ", "").isdigit()


def test_detection_against_plain_rules():
    """Emails and names by separate plain searches over random texts."""
    rnd = random.Random(6)
    words = ["a.b@cd.org", "x@y", "Anna", "Anna Smith", "plain", "@", "me@host.co.uk", "123-45-6789", "Paul", "q@w.e@r.ty", "+49 30 123456", "Über", "..", "%"]
    for _ in range(300):
        text = "".join(rnd.choice(words) + rnd.choice(["", " ", ",", "\n"]) for _ in range(rnd.randrange(12)))
        got = dict(P.mentions(pa.array([text]))).get(0, [])
        spans = [(a, b) for _, a, b, _ in got]
        assert all(text[a:b] == t for _, a, b, t in got) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        inside = lambda m: any(a < m.end() and m.start() < b for a, b in spans)
        assert all(inside(m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", text))
        assert all(inside(m) for m in re.finditer(r"\b(?:Anna|Paul)\b", text))


def test_long_runs_are_read_once():
    n = 1_000_000
    texts = ["1234 " + "a" * n, "x@" + "a." * (n // 2), "a" * n + "@b.org", "Anna " * (n // 5), "1" * n, "Mr " * (n // 3), "a@b.cc" * (n // 6)]
    began = time.perf_counter()
    got = dict(P.mentions(pa.array(texts)))
    assert time.perf_counter() - began < 30
    assert [(k, b - a) for k, a, b, _ in got[2]] == [("email", n + 6)] and len(got[3]) == n // 10


def test_driver_table_keeps_no_entity(spark, sf_dir):
    from zymolith.llm.queries import op8_surrogates

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r.doc_id: r.text for r in op8_surrogates(spark, sf_dir).collect()}
    ids = list(docs)
    real, left = set(), set()
    for _, m in P.mentions(pa.array([docs[i] for i in ids])):
        real |= {(k, P.normal(k, t)) for k, _, _, t in m}
    for _, m in P.mentions(pa.array([out[i] for i in ids])):
        left |= {(k, P.normal(k, t)) for k, _, _, t in m}
    assert len(real) > 10 and not real & left and len(left) == len(real)
    assert set(out) == set(docs)


def test_account_numbers_keep_their_check_digits():
    right = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    rnd = random.Random(3)
    rest = "".join(rnd.choice("0123456789") for _ in range(18))
    made = [f"DE{P._iban_check('DE', r)}{r}" for r in {rest, rest[::-1], "5" * 18, "0" * 17 + "1"}]
    assert all(right(x) and right(P.surrogate("iban", x, KEY)) for x in made)
    every = [f"DE{k:02d}{rest}" for k in range(100)]
    new = [P.surrogate("iban", x, KEY) for x in every]
    assert len(set(new)) == 100 and sum(map(right, new)) <= sum(map(right, every))
    spaced = P.surrogate("iban", "GB29 NWBK 6016 1331 9268 19", KEY)
    assert right(spaced.replace(" ", "")) and [len(x) for x in spaced.split()] == [4, 4, 4, 4, 4, 2]
    assert spaced.replace(" ", "") == P.surrogate("iban", "GB29NWBK60161331926819", KEY)


def test_addresses_of_version_six():
    text = "at 2001:db8::1, [fe80::1ff:fe23:4567:890a] and 2001:0db8:0:0:0:0:0:1; not 12:30:45, std::cout, a::b, ::1, ::, 1:2:3:4:5:6:7:8:9"
    got = [t for k, _, _, t in dict(P.mentions(pa.array([text])))[0] if k == "ip6"]
    assert got == ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:0db8:0:0:0:0:0:1"]
    new = [P.surrogate("ip6", x, KEY) for x in got]
    norm = [P.normal("ip6", x) for x in new]
    assert norm[0] == norm[2] != P.normal("ip6", got[0]) and new[0].startswith("2001:") and "::" in new[0] and "::" not in new[2]
    assert new[1].startswith("fe80::") and all(P._is_personal_ip6(x) for x in new)
    assert P.surrogate("ip6", norm[0], KEY, 3) != norm[0]


def test_unlisted_names_keep_sounds_and_endings():
    for text in ("Emily", "Priya", "Gonzalo", "Øystein", "Зинаида"):
        new = P.surrogate("given", text, KEY)
        assert new != text and new[-1] == text[-1] and [c.lower() in P.VOWELS for c in new] == [c.lower() in P.VOWELS for c in text] and new[0].isupper()
    assert P.surrogate("name", "Иванова Анна", KEY).split()[1] in P.NAMES["female", "cyrillic"] and P.surrogate("family", "Иванова", KEY).endswith("ва")
    for kind, group in (("given", [a + b + "a" for a in "bcd" for b in "aeiou"]), ("family", [a + b for a in "αβγδ" for b in "εζη"]), ("given", [chr(0x4E00 + k) for k in range(30)])):
        new = [P.surrogate(kind, x, KEY) for x in group]
        assert len(set(new)) == len(group) and {P.shape(kind, x) for x in new} == {P.shape(kind, x) for x in group}


def test_persons_of_no_list(spark):
    texts = {
        1: "Emily Johnson called Priya Patel.",
        2: "Dear Gwendolyn Ashworth, the parcel came. Thanks, Gwendolyn",
        3: "Mohammed Al-Sayed and the Will Grant of the Apache License in San Francisco",
        4: "王伟 met 李娜, 我叫张小明。后来张小明走了，陈教授也走了",
        5: "Иванова Анна пришла",
        6: "phone 5558675309, order 555867530912",
        7: "they will grant it: a dear friend, and Dear Customer, too",
        8: "The Big Annual Meeting Of Friends",
        9: "big annual meeting of the license",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in P.replace_personal_data(docs, KEY).collect()}
    assert {k: r.n_name for k, r in out.items()} == {1: 2, 2: 2, 3: 1, 4: 5, 5: 1, 6: 0, 7: 0, 8: 0, 9: 0}
    assert all(out[k].text == texts[k] for k in (7, 8, 9)) and out[6].n_phone == 1 and out[6].text.endswith("order 555867530912")
    for word in "Emily Johnson Priya Patel Gwendolyn Ashworth Mohammed Sayed 王伟 李娜 张小明 Иванова Анна 5558675309,".split():
        assert all(word not in r.text for r in out.values()), word
    a, b = re.findall("(?<=叫).{3}|(?<=来).{3}", out[4].text)
    assert a == b and out[4].text.endswith("教授也走了") and out[3].text.endswith("and the Will Grant of the Apache License in San Francisco")


def test_recall_and_precision_on_names_of_no_list(spark):
    """Syllable names in prose of small words, with places, organisations, headings and sentence beginnings around them."""
    rnd = random.Random(11)
    syllables = "ka lo mi ren tas vel dor un bri sha quo zel pim nar".split()
    coin = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    plain = sorted({coin(2) + "ly" for _ in range(120)})
    persons = [f"{coin(2).title()}{rnd.choice('aeo')} {coin(3).title()}s" for _ in range(80)]
    noise = ["Lake Kerrin", "Oldham University", "New Dorshire", *(f"{rnd.choice(plain).title()} {rnd.choice(plain).title()}" for _ in range(40))]
    rows, truth = [], {}
    for d in range(300):
        words = [rnd.choice(plain) for _ in range(40)]
        words[0] = words[0].title()
        names = rnd.sample(persons, rnd.randrange(3))
        for n in [*names, *rnd.sample(noise, 2)]:
            words[rnd.randrange(1, len(words))] = n + ","
        text = " ".join(words) + "."
        truth[d] = [n for n in persons if n + "," in text]
        rows.append((d, text))
    out = {r.doc_id: r for r in P.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), KEY).collect()}
    total = sum(map(len, truth.values()))
    missed = sum(n in out[d].text for d, names in truth.items() for n in names)
    found = sum(r.n_name for r in out.values())
    assert total > 200 and missed <= 0.1 * total
    assert total - missed >= 0.95 * found
    assert all(n in out[d].text for d, t in rows for n in noise if n + "," in t)


def test_names_do_not_depend_on_packs(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["Emily Johnson wrote", "an emily johnson here", "Priya Patel said", "Priya Patel left", None, ""] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from zymolith.llm import packs

    one = sorted((r.doc_id, r.text) for r in P.replace_personal_data(docs.repartition(1), KEY).collect())
    monkeypatch.setattr(packs, "CELL_PACKS", 2)
    assert sorted((r.doc_id, r.text) for r in P.replace_personal_data(docs.repartition(6), KEY).collect()) == one
    assert one[0][1] == "Emily Johnson wrote" and "Priya" not in one[2][1]
