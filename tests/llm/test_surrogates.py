import re

from murmur.llm import queries, surrogates

ROWS = [
    (1, "Call +1 (456) 555-2186 or +1-456-555-2186, mail Bob.42@mail8.example.com or BOB.42@MAIL8.EXAMPLE.COM."),
    (2, "card 4111 1111 1111 1111 and 4111111111111111; ip 152.143.123.131. ssn 123-45-6789"),
    (3, "Mr. John Smith met Mrs Smith and Frau Anna Müller, Господин Иван Петров; Señora LÓPEZ"),
    (4, None), (5, ""), (6, "IBAN DE89 3704 0044 0532 0130 00 end"), (None, "a@b.co a@b.co"), (None, "a@b.co a@b.co"),
    (7, "no entity 1.2.3 v 12345"), (8, "x" * 50000 + " bob.42@mail8.example.com"), (9, "+1 (456) 555-2186"),
]


def rewritten(spark, rows, key="k"):
    docs = spark.createDataFrame([(d, t, "r", 1, "e") for d, t in rows], "doc_id long, text string, row string, place int, kind string")
    return surrogates.replace(docs, key)


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10


def test_formats_and_coreference(spark):
    rows = rewritten(spark, ROWS).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[4].text is None and by[5].text == "" and by[7].text == ROWS[8][1] and by[7].n_entities == 0
    one = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-(\d{3})-(\d{3})-(\d{4}), mail (\S+@\S+) or (\S+@\S+)\.", by[1].text)
    assert one.groups()[:3] == one.groups()[3:6] and one[7].upper() == one[8]
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.example\.com", one[7])
    assert by[8].text == "x" * 50000 + " " + one[7] and by[9].text in by[1].text
    two = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}); ip (\d+\.\d+\.\d+\.\d+)\. ssn (\d{3}-\d\d-\d{4})", by[2].text)
    assert two[1].replace(" ", "") == two[2] and luhn(two[1]) == 0 and two[1][0] == "4"
    three = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) and Frau (\w+) (\w+), Господин ([А-Я][а-я]+) ([А-Я][а-я]+ов); Señora ([A-Z]+)", by[3].text)
    assert three[2] == three[3] != three[5] and three[4].endswith("na") and not three[1].endswith("a")
    assert re.fullmatch(r"IBAN DE\d\d( \d{4}){4} \d\d end", by[6].text)
    for _, text in ROWS:
        for secret in ("555-2186", "Bob.42", "4111", "152.143", "123-45", "Smith", "Петров", "3704"):
            assert text is None or all(secret not in (r.text or "") for r in rows)
    assert rewritten(spark, ROWS).collect() == rows and rewritten(spark, ROWS, "other").collect() != rows
    assert rewritten(spark, ROWS).limit(0).count() == rewritten(spark, ROWS[:1]).where("doc_id < 0").count() == 0


def test_distinct_entities_stay_distinct(spark):
    """More one-letter addresses than letters, so first draws must collide."""
    rows = [(i, f"{chr(97 + i % 26)}{i // 26}@q.com") for i in range(150)] + [(1000 + i, f"Mr A{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}") for i in range(100)]
    rows = rewritten(spark, rows).collect()
    mails = [r.text for r in rows if r.doc_id < 1000]
    assert len(set(mails)) == 150 and not {m.split("@")[0] for m in mails if "@q.com" in m}
    assert len({r.text for r in rows if r.doc_id >= 1000}) == 100


def test_no_python_runs(spark, sf, capsys):
    surrogates.replace(spark.read.parquet(f"{sf}/documents.parquet")).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_query_leaves_clean_texts_alone(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    known = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![A-Za-z0-9])\d{16}(?![A-Za-z0-9])")
    rows = queries.QUERIES["op4_surrogates"](spark, d).collect()
    assert len(rows) == len(docs)
    planted = {e for t in docs.values() for e in known.findall(t)}
    assert len(planted) > 20
    for r in rows:
        found = known.findall(docs[r.doc_id])
        assert r.n_entities == len(found)
        assert (r.text == docs[r.doc_id]) == (not found)
        assert not planted & set(known.findall(r.text))


NAMES = [
    (1, "Mr John Paul Smith wrote. Later Smith's note reached John and Mr Smith; SMITH agreed, smith did not."),
    (2, "Mr J. Smith, Dr Anna Weiss and Prof. Lee; Herr Dr. Jürgen von Berg, then Jürgen von Berg. Weiss left."),
    (3, "MR SMITH and MRS O'Brien-Jones saw O'Brien-Jones's dog."),
    (4, "John Smith stays, Smith too, no title here."),
    (5, "Smith Mr Smith Smith@mail.com Foo-Mr Lee"),
    (6, "Mr Smith saw " + "Word " * 20000 + "Smith"),
    (7, "Mr"), (8, "Dr. Иван Петров и Петров"),
]


def test_names_of_any_length_and_untitled_repeats(spark):
    by = {r.doc_id: r for r in rewritten(spark, NAMES + NAMES[:1]).collect()}
    assert by[4].text == NAMES[3][1] and by[4].n_entities == 0 and by[7].text == "Mr"
    one = re.fullmatch(
        r"Mr (\w+) (\w+) (\w+) wrote\. Later (\w+)'s note reached (\w+) and Mr (\w+); (\w+) agreed, smith did not\.", by[1].text
    )
    given, middle, family = one.groups()[:3]
    assert one[4] == one[6] == family and one[7] == family.upper() and one[5] == given != middle and by[1].n_entities == 5
    two = re.fullmatch(
        r"Mr ([A-Z])\. (\w+), Dr (\w+) (\w+) and Prof\. (\w+); Herr Dr\. (\w+) von (\w+), then (\w+) von (\w+)\. (\w+) left\.", by[2].text
    )
    assert two[1] != "J" and two[2] == family and two[10] == two[4] and (two[6], two[7]) == (two[8], two[9])
    assert not {"Anna", "Weiss", "Lee", "Jürgen", "Berg"} & set(two.groups())
    three = re.fullmatch(r"MR (\w+) and MRS (\w+) saw (\w+)'s dog\.", by[3].text)
    assert three[1] == family.upper() and three[2] == three[3]
    five = re.fullmatch(r"(\w+) Mr (\w+) (\S+)@(\S+) Foo-Mr (\w+)", by[5].text)
    assert five[1] == five[2] == family and five[3] != "Smith" and five[5] == two[5]
    assert by[6].text == f"Mr {family} saw " + "Word " * 20000 + family and by[6].n_entities == 2
    eight = re.fullmatch(r"Dr\. (\w+) (\w+) и (\w+)", by[8].text)
    assert eight[2] == eight[3] != "Петров" and eight[1] != "Иван"
