"""Fixed patterns against their plain definition, and what the models add."""

import random
import re
import string

from pyspark.sql import functions as F

from scorekit.llm.catalog import load
from scorekit.llm.secret_scan import scan_secrets, train

BASE = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def base(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text or "") if ok(m)]
    return sorted(found, key=lambda x: (x[0], list(BASE).index(x[1])))


RANDOM = random.Random(8)
SECRET = "".join(RANDOM.choice(string.ascii_letters + string.digits) for _ in range(40))
TEXTS = [
    None, "", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end", "password:short then API_KEY='abcdefghijkl' PassWord=x", "\U0001f600 é secret = abc/def+ghi=12",
    "AKIA" + "A" * 13, "AKIA" + "A1" * 7, "xAKIAAKIA" + "B2" * 8, "token=password: abcdefghijklmnop", "secret==" + "a" * 12, "tokens: aaaaaaaaaaaa", "deadbeef" * 2, "deadbeef" * 2 + "g" + "0" * 15,
    "key " + SECRET + " and more", "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", "api-key: abcdefghijklm apikey\"=\"abcdefghijklm\"", "token=" + "f" * 20 + " " + "e" * 30_000, "passwd = 'AKIA" + "Z" * 16 + "'",
]


def prose(n, seed):
    r = random.Random(seed)
    words = ["nation", "the", "estimate", "responsibilities", "of", "internationalization", "a", "counterrevolutionaries", "snake_case_identifier_names",
             "counter", "revolution", "binaries", "snake_case", "case_name", "identifier", "names", "international", "realization", "_internal", "r_identify"]
    return " ".join(r.choice(words) for _ in range(n))


def test_patterns_and_models(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, prose(200, i)) for i in range(20)] + [(2, TEXTS[2]), (None, TEXTS[11])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, hex int, spans string").repartition(3)
    ratios = train(df)
    got = [(r.doc_id, [(s.start, s.kind, s.end) for s in r.spans]) for r in scan_secrets(df, ratios).collect()]
    assert sorted(((d, [s for s in spans if s[1] != "markov"]) for d, spans in got), key=str) == sorted(((d, base(t)) for d, t in rows), key=str)
    found = dict(got)
    assert found[13] == [(4, "markov", 4 + len(SECRET))]
    assert all(not spans for d, spans in got if d is not None and d >= 100)
    assert all(not any(k == "markov" for _, k, _ in spans) for d, spans in got if d not in (8, 13, 14))  # 14: an assignment spelt with a letter beyond ASCII
    assert [s for s in found[8] if s[1] == "markov"] == [(16, "markov", 32)]  # no pattern has this value, as it follows another one's match


def test_sampling_is_bounded_and_no_rows_are_fine(spark):
    df = spark.createDataFrame([(i, prose(30, i)) for i in range(300)], "doc_id bigint, text string")
    assert len(train(df, sample_docs=30)) == len(train(df.limit(0))) == 67 * 67
    assert scan_secrets(df.limit(0), train(df.limit(0))).count() == 0


def spans_of(spark, ratios, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in scan_secrets(df, ratios).collect()}


def key(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_short_keys_are_found_and_long_words_are_not(spark, sf_dir):
    docs = load(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    ratios = train(docs)
    keys = [key(n, i) for n in (12, 16, 19) for i in range(100)]
    found = spans_of(spark, ratios, ["word " + k + " word" for k in keys])
    assert sum(found[i] == [(5, "markov", 5 + len(k))] for i, k in enumerate(keys)) >= 297  # one is made of common pairs
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9+/_=.-])[A-Z]?[a-z]{11,18}(?![A-Za-z0-9+/_=.-])"), 0)).alias("w")).distinct().limit(2000)
    words = [r.w for r in words.collect() if not re.fullmatch("[a-f]+", r.w)]
    assert len(words) > 100 and not any(spans_of(spark, ratios, words).values())


def test_keys_beside_patterns_and_ordinary_parts(spark, sf_dir):
    ratios = train(load(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"))
    name = "the_nation_and_the_estimate_of_the_information_in_the_station_of_the_other_nations_is"
    keys = [key(40, i) for i in range(50)]
    found = spans_of(spark, ratios, ["deadbeefdeadbeef/" + k for k in keys] + [f"{k}-{'0123456789abcdef' * 2} x" for k in keys])
    for i, k in enumerate(keys):
        assert [x for x in found[i] if x[1] == "hex"] == [(0, "hex", 16)] and [x for x in found[i] if x[1] == "markov"] == [(16, "markov", 17 + len(k))]
        assert any(kind == "markov" and s == 0 and e >= 40 for s, kind, e in found[50 + i])
    inside = spans_of(spark, ratios, [f"{name}={key(24, i)}" for i in range(100)] + [f"{key(24, i)}/{name}/{name}/{key(16, i + 500)}" for i in range(100)])
    for i in range(100):
        assert any(s <= len(name) + 3 and e >= len(name) + 23 for s, _, e in inside[i])
        marks = {p for s, _, e in inside[100 + i] for p in range(s, e)}
        assert len(marks & set(range(24))) >= 22 and len(marks & set(range(26 + 2 * len(name), 43 + 2 * len(name)))) >= 14


def test_all_texts_count_and_copies_count_once(spark):
    rows = [prose(20, i) for i in range(6000)]
    few = spark.createDataFrame([(t,) for t in rows], "text string")
    odd = spark.createDataFrame([("qzjxk wvqzj kxqzj",)], "text string")
    more = train(few.unionByName(odd))
    assert more != train(few)
    assert train(few.unionByName(odd.crossJoin(spark.range(3000)).select("text"))) == more


# Identifiers that are no samples of the model, as they are found in programs.
NAMES = """
getElementByIdAndClassName XMLHttpRequestEventTarget MAX_BUFFER_SIZE_BYTES SparkSessionBuilder
src/main/java/org/apache/spark/sql/Dataset user_profile_settings_2 isInstanceOfType org/springframework/web/servlet
NullPointerException customer_shipping_address_line_1 toLocaleDateString onBeforeUnloadListener application-properties
DEFAULT_REQUEST_TIMEOUT_MS kubernetes-deployment-manifest numberOfOccurrences node_modules/lodash/package
TransactionManagerImpl background-color-primary py_object_repr_string ThreadPoolExecutorService usr/local/lib/python3
window_partition_by_key IllegalArgumentException request_id_generator_v2 StringBuilderUtils margin-left-auto-md-4
calculateMonthlyInterest LinkedHashMapIterator tests/unit/test_models SOCKET_KEEPALIVE_INTERVAL handleKeyboardShortcut
WebSocketConnection image_thumbnail_width video/mp4/thumbnail_large permission-denied-handler isAuthenticatedUser
PRIMARY_KEY_CONSTRAINT foreign_key_reference AbstractSingletonProxy com/google/common/collect
""".split()
OTHER_WORDS = """
order invoice customer shipment ticket vendor supplier price discount tax region warehouse stock sensor signal voltage battery camera pixel shader
texture vertex matrix vector kernel thread mutex socket packet router gateway cluster replica shard snapshot ledger journal cursor scheduler
""".split()


def other_names():
    r, out = random.Random(4), []
    for i in range(160):
        a, b, c = r.sample(OTHER_WORDS, 3)
        out.append([a + b.title() + c.title(), f"{a}_{b}_{c}", f"{a.title()}{b.title()}Impl", f"{a.upper()}_{b.upper()}_ID", f"{a}/{b}/{c}", f"{a}-{b}-{i % 9}"][i % 6])
    return out


def test_identifiers_are_ordinary_and_keys_of_any_alphabet_are_not(spark, sf_dir):
    ratios = train(load(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"))
    names = NAMES + other_names()
    found = spans_of(spark, ratios, [f"x {n} x" for n in names])
    assert len(names) > 200 and sum(bool(found[i]) for i in range(len(names))) <= 8
    least = {string.ascii_letters + string.digits: 98, string.ascii_letters + string.digits + "+/": 97, string.ascii_lowercase + string.digits: 93,
             string.ascii_uppercase + string.digits: 96, string.ascii_lowercase: 75, string.ascii_uppercase: 88}
    for alphabet, bar in least.items():
        for n in (12, 16, 19, 20, 32, 40):
            draws = [random.Random(n * 1000 + i) for i in range(100)]
            found = spans_of(spark, ratios, ["x " + "".join(r.choice(alphabet) for _ in range(n)) + " x" for r in draws])
            assert sum(any(e - s >= 0.8 * n for s, _, e in spans) for spans in found.values()) >= bar, (alphabet, n)


def test_own_samples_of_identifiers(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    text = ["x qzXvkjWqPzzQxvBw x"]
    assert spans_of(spark, train(docs, identifiers=[]), text)[0] and not spans_of(spark, train(docs, identifiers=["qzXvkjWqPzzQxvBw"] * 500), text)[0]
