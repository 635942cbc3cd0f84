import re

from llm.helpers import frame, odd_texts

from qaloom.llm import surrogates

KEY = "secret of the test"


def replaced(spark, texts):
    got = surrogates.replace_entities(frame(spark, texts), KEY, count="n_entities")
    return {r.doc_id: r for r in got.collect()}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def test_texts_without_entities_stay(spark):
    texts = odd_texts() + ["Version 2.0 of 12 parts, 3.14 and 100%", "The end. And then", "CC BY-NC 4.0", "in 1984-1985"]
    got = replaced(spark, texts)
    assert {i: r.text for i, r in got.items()} == dict(enumerate(texts)) and not any(r.n_entities for r in got.values())
    assert surrogates.replace_entities(frame(spark, []), KEY).count() == 0


def test_surrogates_keep_kind_and_form(spark):
    texts = [
        "write to Ann.B7@mail.example.com now", "call +1 (017) 555-7713!", "from 10.1.2.3 and 152.143.123.131.",
        "pay 4539 1488 0343 6467 or 4539148803436467", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "SSN 123-45-6789",
        "IBAN DE89 3704 0044 0532 0130 00 here", "2001:0db8:0000:0000:0000:ff00:0042:8329", 'PASSWORD: "hunter2hunter"', "+1%%% (017)### 555-7713***",
    ]
    got = replaced(spark, texts)
    for i, text in enumerate(texts):
        assert got[i].text != text and got[i].n_entities >= 1
        shape = lambda t: re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "0", t)))
        if i not in (2, 4, 7):
            assert shape(got[i].text) == shape(text)
    found = re.findall(r"\d+\.\d+\.\d+\.\d+", got[2].text)
    assert len(found) == 2 and found[0].startswith("10.") and all(int(x) < 256 for ip in found for x in ip.split("."))
    cards = re.findall(r"\d[\d ]{14,}\d", got[3].text)
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) == luhn("4539148803436467") and cards[1][0] == "4"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[4].text)
    assert re.sub(r"\D", "", got[1].text) == re.sub(r"\D", "", got[9].text)


def test_one_entity_has_one_surrogate_and_two_have_two(spark):
    mails = [f"user{k}@host{k % 3}.example.org" for k in range(300)]
    texts = mails + [m.upper() for m in mails] + [" ".join(mails)]
    got = replaced(spark, texts)
    new = [got[k].text for k in range(300)]
    assert len(set(new)) == 300 and not set(new) & set(mails)
    assert [got[300 + k].text for k in range(300)] == [m.upper() for m in new]
    assert got[600].text == " ".join(new) and got[600].n_entities == 300
    assert {m.split("@")[1] for m in new} == {got[k].text.split("@")[1] for k in range(3)}


def test_small_forms_are_drawn_until_distinct(spark):
    # 900 of the 1,000 forms of three digits and a fixed start are taken; each must get another one.
    entities = spark.createDataFrame([("secret", f"{k:04d}") for k in range(0, 9000, 10)], "kind string, norm string")
    entities = entities.withColumn("gender", surrogates.F.lit(None).cast("string")).withColumn("script", surrogates.F.lit("latin"))
    drawn = surrogates.draw_surrogates(entities, KEY).collect()
    assert len({r.surrogate for r in drawn}) == 900
    assert not {r.surrogate for r in drawn} & {r.norm for r in drawn}


def test_names_keep_gender_script_and_coreference(spark):
    texts = ["Mr. John Brook met Mrs. Maria Stone.", "Later Mr. Brook and Maria Stone left.", "Господин Сергей Орлов и Госпожа Анна Орлова", "Mrs. Stone"]
    got = replaced(spark, texts)
    first = re.fullmatch(r"Mr\. (\S+) (\S+) met Mrs\. (\S+) (\S+)\.", got[0].text).groups()
    assert not {"John", "Brook", "Maria", "Stone"} & set(first)
    assert got[1].text == f"Later Mr. {first[1]} and {first[2]} {first[3]} left."
    assert got[3].text == f"Mrs. {first[3]}"
    latin = {g: set(surrogates.GIVEN["latin", g].split()) for g in "mf"}
    assert first[0] in latin["m"] and first[2] in latin["f"]
    assert re.fullmatch(r"Господин [А-я]+ [А-я]+ и Госпожа [А-я]+ [А-я]+", got[2].text)


def test_same_rows_and_null_ids(spark):
    docs = frame(spark, ["ip 8.8.8.8"] * 3 + [None], [1, 1, None, 4])
    got = surrogates.replace_entities(docs, KEY)
    assert got.columns == docs.columns and len({r.text for r in got.collect() if r.text}) == 1 and got.count() == 4


def test_values_without_cased_letters_have_a_surrogate(spark):
    masked = ['"password": "********"', 'key = "--------"', "token: '••••••••••'"]
    secrets = ["ひらがなのひみつ", "カタカナノヒミツー", "密码密码密码密码", "كلمةالسرهنا", "סיסמהסודית", "รหัสผ่านลับ", "ꀀꀁꀂꀃꀄꀅꀆꀇ", "!@#$%^&*()", "٣٤٥٦٧٨٩٠"]
    texts = masked + [f'"key": "{s}"' for s in secrets] + ["an 张三@例子.中国 b", "and _@-.com", "Ann.B7@mail.example.com"]
    got = replaced(spark, texts)
    assert [got[k].text for k in range(3)] == masked and not any(got[k].n_entities for k in range(3))
    new = [re.fullmatch(r'"key": "([^"]+)"', got[3 + k].text).group(1) for k in range(len(secrets))]
    assert all(len(a) == len(b) and a != b for a, b in zip(new, secrets)) and len(set(new)) == len(new)
    assert not set(new[0]) - set(surrogates.UNCASED[1][0]) and not set(new[2]) - set(surrogates.UNCASED[0][0])
    assert re.fullmatch(r"[a-z]{8}", new[6]) and re.fullmatch(r"[a-z]{10}", new[7]) and re.fullmatch(r"[0-9]{8}", new[8])
    assert re.fullmatch(r"an [^ -~]{2}@[^ -~]{2}\.中国 b", got[12].text) and got[12].text != texts[12]
    assert re.fullmatch(r"and [a-z]@[a-z]\.com", got[13].text) and got[14].n_entities == 1 and got[14].text != texts[14]


def test_a_full_form_grows(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ROUNDS", 2)
    # Every form of one digit or letter is a real entity, and so is most of a private block: 64,516 forms.
    block = [("ip", f"192.168.{a}.{b}") for a in range(1, 255) for b in range(1, 255)]
    small = [("secret", str(k)) for k in range(10)] + [("ssn", str(k)) for k in range(10, 20)] + [("email", f"{c}@b.c") for c in "abcdefghijklmnopqrstuvwxyz"]
    entities = spark.createDataFrame(block[::3] + block[1::3] + small, "kind string, norm string").repartition(4)
    entities = entities.withColumn("gender", surrogates.F.lit(None).cast("string")).withColumn("script", surrogates.F.lit("latin"))
    drawn = surrogates.draw_surrogates(entities, KEY).collect()
    forms = {r.surrogate for r in drawn}
    assert len(forms) == len(drawn) == entities.count() and not forms & {r.norm for r in drawn}
    ips = [r.surrogate for r in drawn if r.kind == "ip"]
    assert all(x.startswith(("192.168.", "10.")) for x in ips) and any(x.startswith("10.") for x in ips)
    longer = spark.createDataFrame([("555-1234", ["55598761"])], "m string, d array<string>")
    assert longer.select(surrogates._rendered(surrogates.F.col("m"), surrogates.F.lit("phone"), surrogates.F.col("d"))).first()[0] == "555-98761"


def test_whole_names_and_bare_surnames(spark):
    texts = ["Mr. John Ronald Tolkien wrote. Mr. Tolkien's Tolkien is not Tolkienish.", "President John F. Kennedy and Mr. John F. Kennedy", "Carlos de la Cruz, Señor de la Cruz",
             "Prof. Dr. Maria Stone saw Dr. Stone Mrs. Field", "Stone", "Mr. " + "Ab " * 20000 + "Zz"]
    got = {i: r.text for i, r in replaced(spark, texts).items()}
    a = re.fullmatch(r"Mr\. (\S+) (\S+) (\S+) wrote\. Mr\. (\S+)'s (\S+) is not Tolkienish\.", got[0]).groups()
    assert a[2] == a[3] == a[4] and not {"John", "Ronald", "Tolkien"} & set(a)
    b = re.fullmatch(r"President (\S+) ([A-Z])\. (\S+) and Mr\. (\S+) ([A-Z])\. (\S+)", got[1]).groups()
    assert b[:3] == b[3:] and b[0] == a[0] and b[1] != "F" and b[2] != "Kennedy"
    c = re.fullmatch(r"(\S+) de la (\S+), Señor de la (\S+)", got[2]).groups()
    assert c[1] == c[2] and not {"Carlos", "Cruz"} & set(c)
    d = re.fullmatch(r"Prof\. Dr\. (\S+) (\S+) saw Dr\. (\S+) Mrs\. (\S+)", got[3]).groups()
    assert d[1] == d[2] and not {"Maria", "Stone", "Field"} & set(d) and got[4] == "Stone"
    assert " Ab" not in got[5] and "Zz" not in got[5]


def test_given_names_alone_and_words_of_dates(spark):
    texts = ["John Brook came. John said: Mr. May came in May with Robin Field, Mrs. Robin Field. Robin and Brook left.", "John said"]
    got = {i: r.text for i, r in replaced(spark, texts).items()}
    a = re.fullmatch(r"(\S+) (\S+) came\. (\S+) said: Mr\. (\S+) came in May with Robin Field, Mrs\. (\S+) (\S+)\. (\S+) and (\S+) left\.",
                     got[0].replace("with " + got[0].split("with ")[1].split(",")[0], "with Robin Field")).groups()
    assert a[0] == a[2] and a[1] == a[7] and a[4] == a[6] and a[3] != "May" and got[1] == "John said"
    assert not {"John", "Brook", "Robin", "Field"} & set(a)


def test_numbers_that_are_no_cards_stay_and_hide_nothing(spark):
    texts = ["order 4539148803436468 of 12", "4539148803436467 16.120.181.235 x", "12 4539148803436467", "4539 1488 0343 6468", "45 39 14 88 03 43 64 67",
             "4539 1488 0343 6467 16.120.181.235"]
    got = replaced(spark, texts)
    assert got[0].text == texts[0] and got[0].n_entities == 0
    card, ip = re.fullmatch(r"(\d{16}) (\d+\.\d+\.\d+\.\d+) x", got[1].text).groups()
    assert luhn(card) == 0 and card != "4539148803436467" and ip != "16.120.181.235" and got[1].n_entities == 2
    assert got[2].text == f"12 {card}" and got[3].text != texts[3] and got[4].text.replace(" ", "") == card
    assert got[5].text.split(" ")[:4] == [card[k:k + 4] for k in range(0, 16, 4)] and got[5].text.endswith(ip)


def test_all_kinds_are_distinct_and_domains_stay_apart(spark):
    # 100 domains of two letters in front of the dot: of 676 forms, so some draws meet.
    hosts = [f"{a}{b}.org" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [f"x{k % 7}@{h} from 10.0.{k % 200}.{k % 100 + 1} call +1 (555) 555-{k:04d}" for k, h in enumerate(hosts)]
    texts += [f"Mr. {n} and Mrs. {n}a" for n in ("A" + c + d for c in "bcdfgh" for d in "aeiou")]
    got = replaced(spark, texts)
    new = [got[k].text for k in range(len(hosts))]
    domains = [re.search(r"@(\S+)", t).group(1) for t in new]
    assert len(set(domains)) == len(hosts) and not set(domains) & set(hosts)
    for pattern in (r"\S+@\S+", r"from (\S+)", r"call (.+)"):
        old_of = dict()
        for old, fresh in zip(texts, new):
            assert old_of.setdefault(re.search(pattern, old).group(), re.search(pattern, fresh).group()) == re.search(pattern, fresh).group()
        assert len(set(old_of.values())) == len(old_of) and not set(old_of.values()) & set(old_of)
    names = [w for k in range(len(hosts), len(texts)) for w in re.findall(r"M\w+\. (\S+)", got[k].text)]
    assert len(set(names)) == len(names) == 60


def test_extra_columns_of_any_type_and_name(spark):
    docs = spark.createDataFrame([(1, "ip 8.8.8.8", {"a": 1}, 7), (2, None, None, 8)], "doc_id bigint, text string, `row` map<string,int>, `a.b` int")
    got = {r.doc_id: r for r in surrogates.replace_entities(docs, KEY).collect()}
    assert surrogates.replace_entities(docs, KEY).columns == docs.columns
    assert got[1].row == {"a": 1} and got[1]["a.b"] == 7 and got[1].text != "ip 8.8.8.8" and got[2].text is None
