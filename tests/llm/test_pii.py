import random
import re

from comboscan.llm import pii

SCHEMA = "doc_id long, text string, entities int, _sig string"
CASES = ["ann.lee@mail.example.org", "10.20.30.40", "4111111111111111", "+1 (017) 555-7713", "123-45-6789", "DE89 3704 0044 0532 0130 00", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[::2]) % 10 + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10 in (0, 10, 20) or (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_surrogates_keep_type_shape_and_identity(spark):
    rows = [(i, f"Start {c} middle, again {c}. End", 7, "x") for i, c in enumerate(CASES)]
    rows += [(20, 'api: token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" end', None, None), (21, "Mrs Anna Novak met Mr Novak and Herr Peter Müller.", None, None), (22, "госпожа Анна Иванова здесь", None, None)]
    clean = [(30, "Nothing here: 3.14 of 2024-01-02, 12 apples, e@, v1.2.3, 555.", None, None), (31, None, None, None), (32, "", None, None)]
    rows += clean + [rows[0], (40, "long " * 60_000 + CASES[0], None, None)]
    out = {}
    got = pii.replace(spark.createDataFrame(rows, SCHEMA), "k")
    assert got.columns == ["doc_id", "text", "_sig", "entities"] and got.count() == len(rows)
    for r in got.collect():
        assert out.setdefault(r["doc_id"], r) == r  # repeated rows stay equal
    for i, c in enumerate(CASES):
        new = re.fullmatch(r"Start (.*) middle, again (.*)\. End", out[i]["text"])
        assert new[1] == new[2] != c and out[i]["entities"] == 2
        assert re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", new[1]))) == re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", c))) or i in (1, 6)
    assert all(0 <= int(x) <= 255 for x in re.fullmatch(r"Start (.*) middle.*", out[1]["text"])[1].split("."))
    assert luhn(re.search(r"\d{16}", out[2]["text"])[0])
    assert out[40]["text"].endswith(out[0]["text"].split()[1])  # the same everywhere
    assert re.fullmatch(r'api: token = "[0-9a-f]{40}" end', out[20]["text"]) and "0b96a8" not in out[20]["text"]
    m = re.fullmatch(r"Mrs (\w+) (\w+) met Mr (\w+) and Herr (\w+) (\w+)\.", out[21]["text"])
    assert m[2] == m[3] != "Novak" and m[5] not in ("Müller", m[2]) and m[1].endswith(("a", "elle"))
    assert re.fullmatch(r"госпожа \p{0}+ \p{0}+ здесь".replace(r"\p{0}", "[А-я]"), out[22]["text"]) and "Иванова" not in out[22]["text"]
    for i, t, *_ in clean:
        assert out[i]["text"] == t and out[i]["entities"] == 0
    assert pii.replace(spark.createDataFrame([], SCHEMA), "k").count() == 0
    other = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(rows, SCHEMA), "other key").collect()}
    assert other[0] != out[0]["text"]


def test_collisions_are_drawn_again(spark):
    # 3000 of 100,000,000 numbers, and names from a family of a few thousand: collisions are certain
    rows = [("first_f", f"Name{i}") for i in range(3000)] + [("ssn", f"{i:03d}-00-0000") for i in range(900)]
    made = pii.draw_surrogates(spark.createDataFrame(rows, "kind string, value string"), "k").collect()
    assert len(made) == len(rows) == len({(r["kind"], r["surrogate"]) for r in made})
    assert not {(r["kind"], r["surrogate"]) for r in made} & set(rows)


def test_addresses_after_signs_and_secrets_of_letters(spark):
    a = "jane@example.com"
    texts = [f"see {a} now", f"see _{a}_ now", f"see -{a} now", f"see ...{a} now", f"see +{a} now", f"see %.{a} now", f"see Mr Jane1{a} now", f"call +1 555-123-4567.{a} now"]
    secrets = ["sk-" + "abcdefghij" * 2, "AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "abcdefghijkl" * 3]
    rows = [(i, t, None, None) for i, t in enumerate(texts + [f"key {s} here" for s in secrets])]
    out = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    new = re.fullmatch(r"see (\w+@\w+\.com) now", out[0]["text"])[1]
    assert new != a
    for i, lead, tail in ((1, "_", "_"), (2, "-", ""), (3, "...", ""), (4, "+", ""), (5, "%.", "")):
        assert out[i]["text"] == f"see {lead}{new}{tail} now"  # the same address, what is around it stays
    for i in (6, 7):
        assert a not in out[i]["text"] and out[i]["entities"] == 2
    for i, s in enumerate(secrets, len(texts)):
        assert s not in out[i]["text"] and out[i]["entities"] == 1


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_names_numbers_and_domains_stay_consistent(spark):
    texts = [
        "Mr John Smith came. Later John Smith agreed; Johnson and John Smithers did not.", "Dr Anna Petrova and Mrs Anna Petrova, then Anna Petrova.",
        "pay DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819 now", "no entity: John Smith",
    ]
    texts += [f"write u{i}@ab.com or v{i}@{a}{b}.com" for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "abcdefghij")]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    m = re.fullmatch(r"Mr (\w+ \w+) came. Later (\w+ \w+) agreed; Johnson and John Smithers did not.", out[0]["text"])
    assert m[1] == m[2] != "John Smith" and out[0]["entities"] == 2
    m = re.fullmatch(r"Dr (\w+ \w+) and Mrs (\w+ \w+), then (\w+ \w+).", out[1]["text"])
    assert m[1] == m[2] == m[3] and out[1]["entities"] == 3
    m = re.fullmatch(r"pay ([A-Z0-9 ]+) or ([A-Z0-9]+) now", out[2]["text"])
    assert iban_ok(m[1]) and iban_ok(m[2]) and m[1][:2] == "DE" and m[2][:2] == "GB" and len(m[1]) == 27
    assert out[3]["text"] == texts[3]
    domains = {}
    for i in range(4, len(texts)):
        old, new = re.findall(r"@(\S+)", texts[i]), re.findall(r"@(\S+)", out[i]["text"])
        for a, b in zip(old, new, strict=True):
            assert domains.setdefault(a, b) == b
    assert len(set(domains.values())) == len(domains) == 100 and not set(domains) & set(domains.values())


def test_long_runs_of_signs_do_not_break_the_matcher(spark):
    runs = ["a@" + "b." * 500_000, "a." * 500_000 + "@", "1 " * 300_000, "AB12" * 250_000, "Mr " * 300_000, "token=" + "x" * 1_000_000, "1.2." * 200_000, "a@b" * 300_000]
    rows = [(i, t, None, None) for i, t in enumerate(runs + ["a@" + "b." * 500_000 + "com"])]
    out = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    assert len(out) == len(rows) and out[len(runs)]["entities"] == 1 and out[5]["entities"] == 1 and out[0]["text"] == runs[0]


def test_texts_are_rebuilt_from_gaps_and_surrogates(spark):
    """Every text against a rebuild by string replacement: what stands between entities stays, and an entity has one surrogate."""
    rnd = random.Random(7)
    pool = CASES + ["Mrs Anna Novak", "Mr Novak", "ghp_" + "a1B2" * 9, "bob@ab.com", "eve@mail.example.org"]
    plain = ["word", "x", "3.14,", "\n", "Ünï", "--", "v1.2.3"]
    texts = [f"<{p}>" for p in pool] + ["; ".join(rnd.choice(pool if rnd.random() < 0.3 else plain) for _ in range(rnd.choice([1, 5, 60]))) for _ in range(80)]
    out = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA), "k").collect()}
    new = {p: out[i][1:-1] for i, p in enumerate(pool)}
    assert len(set(new.values())) == len(pool) and not set(new.values()) & set(pool)
    for i in range(len(pool), len(texts)):
        assert out[i] == "; ".join(new.get(w, w) for w in texts[i].split("; "))
