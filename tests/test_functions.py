import pytest
from helpers import apply
from pyspark.sql import functions as F

from trailmark.functions import text as X
from trailmark.functions import web as W


@pytest.mark.parametrize("digits", range(9, 23))
@pytest.mark.parametrize("gap", ["", " ", "-"])
def test_runs_of_digits(spark, digits, gap):
    """13 to 19 digits make a card, with single blanks or dashes between them or none. What is longer stays, but for blanks."""
    places = [str(place % 10) for place in range(digits)]
    text = f"<{gap.join(places)}>"
    wanted = "<[card]>" if 13 <= digits <= 19 else text
    if digits > 19 and gap == " ":
        wanted = f"<[card] {' '.join(places[19:])}>"
    assert apply(spark, X.redact_text, [text]) == [wanted]


@pytest.mark.parametrize("before, after", [("_", ""), ("", "_"), ("x", ""), ("-", ""), ("", "-")])
def test_digits_inside_a_word_stay(spark, before, after):
    text = f"{before}{'9' * 15}{after}"
    assert apply(spark, X.redact_text, [text]) == [text]


@pytest.mark.parametrize("digits", range(6, 19))
def test_international_numbers(spark, digits):
    """A plus and 8 digits or more, until there are enough for a card, which goes first."""
    text = "+" + "7" * digits
    wanted = text if digits < 8 else "[phone]" if digits < 13 else "+[card]"
    assert apply(spark, X.redact_text, [f"({text})"]) == [f"({wanted})"]


@pytest.mark.parametrize("first", ["(305) ", "(305)", "305-", "305."])
@pytest.mark.parametrize("second", ["-", "."])
def test_national_numbers(spark, first, second):
    number = f"{first}404{second}5055"
    assert apply(spark, X.redact_text, [f"at {number},"]) == ["at [phone],"]
    assert apply(spark, X.redact_text, [f"at {number}6"]) == [f"at {number}6"]


def test_order_of_the_rules(spark):
    """Addresses go first, so digits in them are no card, and a card is no phone."""
    texts = ["1234567890123@digits.test", "a@b", "a@b.c", "a@b.cd", "a..b%c@d-e.f.gh!", "4000123412341234 305-404-5055 z@y.xx", "", None]
    wanted = ["[email]", "a@b", "a@b.c", "[email]", "[email]!", "[card] [phone] [email]", "", None]
    assert apply(spark, X.redact_text, texts) == wanted


def test_redact_url(spark):
    pairs = [
        ("s://h/p?a=b%40c.de", "s://h/p?a=%5Bemail%5D"),
        ("s://h/p?u=v#t=b@c.de", "s://h/p?u=v#t%3D%5Bemail%5D"),
        ("s://h/4000123412341234", "s://h/4000123412341234"),
        ("s://h/?n=4000123412341234&m=1", "s://h/?n=%5Bcard%5D&m=1"),
        ("s://h/?x=%zz&y=%&z=%4", "s://h/?x=%zz&y=%&z=%4"),
        ("s://h/?&&=&a", "s://h/?&&=&a"),
        ("s://h/?b@c.de=1", "s://h/?b@c.de=1"),
        ("s://h/?#", "s://h/?#"),
        ("no url", "no url"),
        ("", ""),
        (None, None),
    ]
    assert apply(spark, X.redact_url, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_truncate_counts_utf16_units(spark):
    values = ["xy\U0001f600", "xyz", "xyzw", "é" * 5, "\U0001f600\U0001f600", None]
    assert apply(spark, lambda c: X.truncate(c, 3), values) == ["xy", "xyz", "xyz", "ééé", "\U0001f600", None]


def test_masks(spark):
    assert apply(spark, X.mask, ["abc", "", None]) == ["***", "", None]
    assert apply(spark, X.mask_text, ["a bc\td"]) == ["* **\t*"]
    assert apply(spark, X.mask_sensitive, ["hunter2", "", None]) == ["******", "", None]


def test_sensitive_names(spark):
    """A secret is a word of the name, wherever words begin and end."""
    around = ["{}", "{}_x", "x.{}", "9{}9", "Page {}", "{}-", "x{}", "{}x", "xx{}"]
    names = [form.format(word) for form in around for word in ("cvn", "Otp", "CVC")]

    def wanted(form, word):
        if form == "x{}":
            return word == "Otp" or word == "CVC"  # a capital begins a word
        if form == "{}x":
            return False
        return form != "xx{}" or word != "cvn"

    expected = [wanted(form, word) for form in around for word in ("cvn", "Otp", "CVC")]
    assert apply(spark, X.is_sensitive_name, names) == expected
    assert [X.names_secret(name) for name in names] == expected


@pytest.mark.parametrize("port", ["", ":", ":1", ":65535", ":123456", ":8o", ":80/", ":80:80"])
@pytest.mark.parametrize("scheme", ["ftp", "FTP", "ftps"])
@pytest.mark.parametrize("name", ["files.test", "files.test.evil", "a.files.test"])
def test_any_port_of_one_host(spark, scheme, name, port):
    allowed = F.array(F.lit("ftp://Files.test:*"))
    fits = scheme.lower() == "ftp" and name == "files.test" and port in ("", ":1", ":65535")
    assert apply(spark, lambda c: W.origin_allowed(c, allowed), [f"{scheme}://{name}{port}"]) == [fits]


def test_exact_origins(spark):
    allowed = F.array(F.lit(" wss://one.test:7/ "), F.lit("*"), F.lit("null"), F.lit("two.test:*"), F.lit("three://:*/"), F.lit(None))
    given = ["wss://one.test:7", "WSS://ONE.test:7", "wss://one.test:77", "wss://one.test", "two.test:5", "*", "null", "", "  ", None]
    assert apply(spark, lambda c: W.origin_allowed(c, allowed), given) == [True, True] + [False] * 8
    assert apply(spark, lambda c: W.origin_allowed(c, F.lit(None).cast("array<string>")), ["wss://one.test:7"]) == [False]


DEVICES = {
    "(Windows NT 6)": "desktop",
    "(X11; CrOS)": "desktop",
    "(Android 9; Mobile)": "mobile",
    "(Android 9)": "tablet",
    "(iPod)": "mobile",
    "(iPad)": "tablet",
    "(Tablet; Mobile)": "tablet",
    "(Toaster)": None,
    "(Windows; Spider)": None,
}
PRODUCTS = {
    "Chrome/7.1 Safari/1": "Chrome 7",
    "CriOS/8 Safari/1": "Chrome 8",
    "Chrome/7 Edg/9.9": "Edge 9",
    "Chrome/7 OPR/10": "Opera 10",
    "SamsungBrowser/11 Chrome/7": "Samsung Internet 11",
    "FxiOS/12.3": "Firefox 12",
    "Version/13.4 Safari/1": "Safari 13",
    "Version/14 Mobile/A1 Safari/1": "Safari 14",
    "Safari/1": None,
}


def test_user_agents(spark):
    agents = [(f"Any/1 {device} {product}", device, product) for device in DEVICES for product in PRODUCTS]
    texts = [agent for agent, _, _ in agents]
    mobile = {"Version/14 Mobile/A1 Safari/1": {"(Windows NT 6)": "mobile", "(X11; CrOS)": "mobile", "(Android 9)": "mobile", "(Toaster)": "mobile"}}
    platforms = [mobile.get(product, {}).get(device, DEVICES[device]) for _, device, product in agents]
    assert apply(spark, W.platform_of, texts) == platforms
    assert apply(spark, W.browser_of, texts) == [PRODUCTS[product] for _, _, product in agents]
    assert apply(spark, W.browser_of, ["curl/6", "x curl/6", "HeadlessChrome/5", "", None]) == ["curl 6", None, "HeadlessChrome 5", None, None]


def test_small_ones(spark):
    assert apply(spark, W.cut_fragment, ["a#b#c", "a", ""]) == ["a", "a", ""]
    assert apply(spark, W.is_uuid, ["0A1b2c3d-0000-7000-8000-00000000000f", "x", ""]) == [True, False, False]
    assert apply(spark, lambda c: W.object_key(F.lit("t"), F.lit("s"), c), [12], "int") == ["tenants/t/sessions/s/000012.json.zst"]


def test_cosine(spark):
    from trailmark.functions.vectors import cosine_distance_to, cosine_similarity

    rows = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id int, v array<float>"
    ).orderBy("id")
    distances = [r[0] for r in rows.select(cosine_distance_to(F.col("v"), [1.0, 0.0])).collect()]
    assert distances[:2] == [0.0, 1.0] and abs(distances[2] - (1 - 0.5**0.5)) < 1e-6 and distances[3:] == [None] * 3
    target = F.array(F.lit(1.0), F.lit(0.0))
    similar = [r[0] for r in rows.select(cosine_similarity(F.col("v"), target)).collect()]
    assert similar[:2] == [1.0, 0.0] and similar[3:] == [None] * 3
