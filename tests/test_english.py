"""The stemmer against known stems of the Snowball English vocabulary, and its two renderings against one another."""

import duckdb

from catalux.functions import english

# Words and stems.
KNOWN = dict(x.split(":") for x in """
consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistent:consist consistently:consist consisting:consist consists:consist
consolation:consol consolations:consol consolatory:consolatori console:consol consoled:consol consoling:consol consolingly:consol conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci
conspirator:conspir constable:constabl constancy:constanc constant:constant knack:knack knackeries:knackeri knacks:knack knag:knag knave:knave knaves:knave knavish:knavish kneaded:knead kneading:knead
kneel:kneel kneeled:kneel knees:knee knell:knell knew:knew knick:knick knif:knif knife:knife knight:knight knightly:knight knights:knight knit:knit knits:knit knitted:knit knitting:knit knives:knive
generate:generat generates:generat generating:generat general:general generally:general generic:generic generically:generic generous:generous generously:generous communism:communism arsenal:arsenal
happy:happi transplant:transplant transplants:transplant transplantation:transplant relational:relat hopping:hop hoping:hope hoped:hope dying:die skies:sky luxuriated:luxuri cries:cri cry:cri by:by say:say
ties:tie tied:tie gas:gas this:this gaps:gap kiwis:kiwi bus:bus class:class caresses:caress national:nation rational:ration conditional:condit digitizer:digit radically:radic vietnamization:vietnam
predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formality:formal sensitivity:sensit sensibility:sensibl triplicate:triplic formative:format
formalize:formal electricity:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt activate:activ angularity:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas
control:control roll:roll agreed:agre feed:feed plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail
filing:file inning:inning succeed:succeed proceeding:proceed outing:outing early:earli only:onli news:news youth:youth boyish:boyish yellow:yellow employed:employ analogies:analog apology:apolog
before:befor patients:patient treatment:treatment treatments:treatment surgery:surgeri surgeries:surgeri consultation:consult consultations:consult dentist:dentist ab:ab x2y3s:x2y3s
""".split())


def test_known_stems(spark):
    got = {r.word: r.term for r in english.stemmed(spark.createDataFrame([(w,) for w in KNOWN], "word string")).collect()}
    assert {w: (got[w], s) for w, s in KNOWN.items() if got[w] != s} == {}


def test_both_engines_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = docs.selectExpr("explode(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+', 0)) AS word").distinct()
    made = [(a + b + s,) for a in ("gener", "fy", "yoyy", "ca", "hol", "str", "") for b in ("at", "al", "bb", "iz", "o", "ay") for s in ("ing", "ed", "eedly", "ies", "ational", "ousli", "logi", "ement", "ion", "sses", "y", "e", "ll", "us", "ative", "ness")]
    words = words.unionAll(spark.createDataFrame(made, "word string"))
    got = {r.word: r.term for r in english.stemmed(words).collect()}
    c = duckdb.connect()
    c.execute("create table w as select unnest(?::varchar[]) as word", [list(got)])
    assert got == dict(c.execute(f"WITH {english.stem_sql('w', 'stems')} SELECT word, term FROM stems").fetchall())


def test_stop_words():
    assert len(english.STOP_WORDS) == len(set(english.STOP_WORDS)) == 127


def test_stem_of_one_word(spark):
    made = {a + b + s for a in ("gener", "arsen", "fy", "yoyy", "ca", "hol", "é", "") for b in ("at", "al", "bb", "iz", "o", "ay", "ss") for s in ("ing", "ed", "eedly", "ies", "ied", "s", "ational", "ousli", "logi", "li", "ement", "sion", "ion", "sses", "y", "e", "ll", "us", "ative", "ness")}
    words = sorted(made | set(KNOWN) | set(english.SPECIAL) | {w + "s" for w in english.KEPT})
    got = {r.word: r.term for r in english.stemmed(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {w: english.stem(w) for w in words} == got
