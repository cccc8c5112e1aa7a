"""Replacement of personal data and secrets by keyed surrogates, in DataFrame functions only.

1. One pass of one pattern sets a mark on both sides of every mention. The marked texts
   are stored once; mentions and what stands between them are cut from them.
2. Each distinct mention has parts, each with a kind and a canonical form, from which
   case, punctuation, country codes and titles are gone. A name's parts are its words, so
   that a full name, a bare surname and a name with a title share them; a phone number
   has the same form with its country code and without.
3. The table of distinct forms gets surrogates: letters and digits are drawn anew by a
   hash of key, kind and form, in the same script and class. Names are made of syllables
   of their script, with endings of their gender. Addresses of networks go to private
   ranges, card numbers and bank accounts keep right check digits if they had them.
4. Where two forms of a kind would get the same surrogate, or one that is itself a form of
   the texts, all but the first of them draw again, from a space that grows with the
   attempt, until none collide. So distinct entities stay distinct, and an entity has one
   surrogate wherever and however it is written: each mention's surrogate is put into that
   mention's own case, punctuation and title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store

# fixed values: titles by gender, given names that count without a title, first characters of Chinese names
FEMALE_TITLES = "Mrs Ms Miss Madam Dame Lady Frau Madame Mme Mademoiselle Mlle Señorita Señora Srta Sra Signora Госпожа Κυρία".split()
MALE_TITLES = "Mr Mister Sir Lord Herr Monsieur Señor Sr Signor Господин Κύριος".split()
OTHER_TITLES = "Dr Doctor Prof Professor".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Emily Emma Olivia Sophia Anna Maria Julia Laura Marie Claire Camille Carmen Lucía Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Μαρία Ελένη".split()
MALE_NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Peter Paul Stefan Hans Klaus Jürgen Pierre Jean Carlos José Miguel Иван Александр Дмитрий Сергей Андрей Алексей Михаил Николай Γιώργος Νίκος".split()
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
# fixed values: international dialling codes of one and two digits; all others have three
DIALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES) + ")"
_LEAD = rf"(?:{_TITLE}\b\.? ){{1,3}}"
#: A capitalised word with its hyphens and inner capitals, that is no title.
_WORD = rf"(?!{_TITLE}\b)\p{{Lu}}(?:['’]\p{{Lu}})?[\p{{Ll}}\p{{M}}]{{1,30}}+(?:(?:-\p{{Lu}}?|['’]\p{{Lu}}|\p{{Lu}})[\p{{Ll}}\p{{M}}]{{1,30}}+){{0,3}}+(?!\p{{L}})"
_GIVEN = "(?:" + "|".join(FEMALE_NAMES + MALE_NAMES) + ")"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_STREET = "(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)"

#: Kind, what it begins with, pattern; at the begin of a word the first that fits counts. Patterns hold no capturing groups and no open repetition.
KINDS: tuple[tuple[str, str, str], ...] = (
    ("email", "[A-Za-z0-9]", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("hex", "[A-Fa-f0-9]", r"(?=[A-Fa-f]{0,128}[0-9])(?=[0-9]{0,128}[A-Fa-f])[A-Fa-f0-9]{32,128}(?![A-Za-z0-9])"),
    ("secret", "[Agsx]", r"(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,256}(?![A-Za-z0-9])"),
    ("ipv6", "[0-9A-Fa-f:]", rf"(?<![:.])(?=[A-Fa-f:]{{0,39}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:|::{_HEX}(?::{_HEX}){{0,6}})(?![0-9A-Za-z:])"),
    ("ip", "[0-9]", rf"(?<![.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("iban", "[A-Z]", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])"),
    ("ssn", "[0-9]", r"(?<![-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", "[0-9]", r"(?<![-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9-])"),
    ("phone", "[+(]", r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("phone", "[+]", r"\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}(?![0-9])"),
    ("phone", "[0-9]", r"(?<![.-])(?:1[.-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("address", "[0-9]", rf"[0-9]{{1,5}} (?:\p{{Lu}}[\p{{Ll}}\p{{M}}]{{1,30}} ){{1,3}}{_STREET}(?![\p{{L}}\p{{N}}])"),
    ("address", r"\p{Lu}", r"\p{Lu}[\p{Ll}\p{M}]{2,30}(?:straße|strasse|gasse|allee|platz|weg) [0-9]{1,4}(?![0-9])"),
    ("name", r"\p{Lu}", rf"(?:{_LEAD}(?:\p{{Lu}}\. ){{0,2}}{_WORD}(?: (?:\p{{Lu}}\. )?{_WORD})?|{_GIVEN} (?:\p{{Lu}}\. )?{_WORD})"),
)
#: Names of scripts without spaces, which need not stand at the begin of a word.
CJK = rf"(?:[{HAN_SURNAMES}]\p{{IsHan}}{{1,2}}(?:先生|女士|小姐|太太)|\p{{IsHan}}{{2,4}}(?:さん|様|氏)|(?<!\p{{IsHangul}})\p{{IsHangul}}{{2,4}} ?씨(?!\p{{IsHangul}}))"
#: Begins of words are told by one look back; what cannot begin there is left at once.
PATTERN = r"(?<![\p{L}\p{N}])(?=[A-Za-z0-9+(:\p{Lu}])(?:" + "|".join(f"(?={f})(?:{p})" for _, f, p in KINDS) + ")|" + rf"(?=[\p{{IsHan}}\p{{IsHangul}}]){CJK}"
LEAD, TAIL = rf"^({_LEAD})", r"( ?씨|先生|女士|小姐|太太|さん|様|氏)$"
#: Rounds of new draws; each leaves only what still collides, in a larger space.
MOST_ROUNDS = 50

#: Consonants, vowels, and endings of given names of women and of men and of surnames, by script.
SYLLABLES = {
    "latin": ("b d f g h j k l m n p r s t v z", "a e i o u", ("na la ra ia", "n l r s", "ner rich son tz")),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х", "а е и о у", ("на ла ра ия", "н л р с", "нко вич рин дзе")),
    "greek": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ", "α ε η ι ο", ("να λα ρα ία", "νης λος ρος σος", "πουλος δης κης νος")),
}
#: Characters of names of scripts of whole syllables, in the same order.
WHOLE = {
    "han": ("芳丽娜敏静秀英华慧巧美娟霞燕玲雪琳萍红玉", "伟强磊军勇杰涛明超刚平辉鹏斌波宁浩亮成健", HAN_SURNAMES),
    "hangul": ("나라미하유지은수연희아린서현채윤소예다인", "민준호진우성현석철영훈태건도윤재혁승빈찬", "가나다라마바사아자차하기니디리미비시이지"),
}
LETTERS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
MARK, CODE = "\u0001", "\u0002"


def kind_of(mention: Column) -> Column:
    out = F.when(mention.rlike(f"^(?:{CJK})$"), "name")
    for kind, _, pattern in KINDS:
        out = out.when(mention.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("other")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _phone(mention: Column) -> Column:
    """The number within its country, without a 0 in front."""
    digits = _digits(mention)
    abroad = F.regexp_replace(digits, f"^(?:{DIALLING}|[0-9]{{3}})", "")
    home = F.when(digits.rlike("^1[0-9]{10}$"), F.substring(digits, F.lit(2), F.lit(10))).otherwise(digits)
    number = F.regexp_replace(F.when(mention.startswith("+"), abroad).otherwise(home), "^0+", "")
    return F.when(number == "", digits).otherwise(number)


def _ipv6(mention: Column) -> Column:
    """All eight groups, without zeros in front."""
    low = F.lower(mention)
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    before, after = groups(F.substring_index(low, "::", 1)), groups(F.when(low.contains("::"), F.substring_index(low, "::", -1)).otherwise(F.lit("")))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(before) - F.size(after)))
    return F.array_join(F.transform(F.concat(before, zeros, after), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def _parts(mention: Column, kind: Column) -> Column:
    """Array of (word, kind, form) of a mention; initials have no form."""
    spaced = F.split(F.regexp_replace(mention, LEAD, ""), " ")
    bare = F.regexp_replace(mention, TAIL, "")
    han = F.array(F.substring(bare, 1, 1), F.substring(bare, F.lit(2), F.length(bare)))
    whole = mention.rlike(f"^(?:{CJK})$")
    words = F.when(whole & mention.rlike("(?:さん|様|氏)$"), F.array(bare)).when(whole, han).otherwise(spaced)
    given = F.when(whole, F.get(words, F.lit(1))).otherwise(F.get(words, F.lit(0)))
    titled = lambda titles: mention.rlike(rf"^(?:{_TITLE}\b\.? )*?(?:{'|'.join(titles)})\b\.? ")
    female = F.when(titled(FEMALE_TITLES) | mention.rlike("(?:女士|小姐|太太)$"), True).when(titled(MALE_TITLES) | mention.rlike("先生$"), False)
    female = female.when(given.isin(FEMALE_NAMES), True).when(given.isin(MALE_NAMES), False).otherwise(given.rlike("[aаяαη]$"))
    gendered = F.when(female, "given-f").otherwise("given-m")
    alone = F.size(words) == 1
    first = F.when(alone & ~mention.rlike("^(?:Sir|Dame|Lady|Lord) "), "surname").when(whole, "surname").otherwise(gendered)
    later = F.when(whole, gendered).otherwise("surname")
    names = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.when(i == 0, first).otherwise(later).alias("kind"), F.when(~w.rlike(r"^\p{Lu}\.$"), F.lower(w)).alias("form")))
    form = F.when(kind.isin("email", "hex", "address"), F.lower(mention)).when(kind == "phone", _phone(mention)).when(kind == "ipv6", _ipv6(mention))
    form = form.when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind.isin("card", "ssn"), _digits(mention)).otherwise(mention)
    return F.when(kind == "name", names).otherwise(F.array(F.struct(mention.alias("word"), kind.alias("kind"), form.alias("form"))))


def _draw(seed: Column, at: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, at), F.lit(n)).cast("int")


def _pick(seed: Column, at: Column, choices: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, choices)), _draw(seed, at, len(choices)))


def _redraw(text: Column, seed: Column, keep: int = 0) -> Column:
    """Each letter and digit drawn anew in its class and script, after the first ``keep``; a hexadecimal text stays one."""
    hexadecimal = text.rlike("^[0-9a-f]+$")

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))
        new = F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), F.when(hexadecimal, pick("abcdef")).otherwise(pick(LETTERS["lower"])))
        new = new.when(c.rlike("[A-Z]"), pick(LETTERS["upper"])).when(c.rlike(r"\p{IsCyrillic}"), pick(LETTERS["cyrillic"])).when(c.rlike(r"\p{IsGreek}"), pick(LETTERS["greek"]))
        return F.when(i < keep, c).otherwise(new.when(c.rlike(r"\p{L}"), pick(LETTERS["lower"])).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit rule of cards; 0 modulo 10 for a right number."""
    values = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 1, F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v)


def _mod97(account: Column) -> Column:
    """Remainder of a bank account's number, its first four characters put last; 1 for a right one."""
    turned = F.split(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: F.pmod(F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c), F.lit(97)))


def _name(kind: Column, form: Column, attempt: Column, seed: Column) -> Column:
    """A name of the form's script, its kind's gender, and about its length; longer with each attempt."""
    by_kind = lambda three: F.when(kind == "given-f", three[0]).when(kind == "given-m", three[1]).otherwise(three[2])

    def spelt(piece: Column, script: str, own: Column) -> Column:
        consonants, vowels, endings = SYLLABLES[script]
        n = F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.length(piece) / 2) - 1)) + attempt
        body = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(_pick(own, i, consonants.split()), _pick(own, i + 1000, vowels.split())))
        return F.concat(F.array_join(body, ""), by_kind([_pick(own, F.lit(-1), e.split()) for e in endings]))

    def pieces(script: str) -> Column:
        each = lambda p, i: F.concat(F.regexp_extract(p, "^(?:.['’])?", 0), spelt(p, script, F.concat(seed, i.cast("string"))))
        return F.array_join(F.transform(F.split(form, "-"), each), "-")

    def whole(script: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form) + attempt), lambda i: by_kind([_pick(seed, i, list(c)) for c in WHOLE[script]])), "")

    out = F.when(form.rlike(r"\p{IsHan}"), whole("han")).when(form.rlike(r"\p{IsHangul}"), whole("hangul"))
    return out.when(form.rlike(r"\p{IsCyrillic}"), pieces("cyrillic")).when(form.rlike(r"\p{IsGreek}"), pieces("greek")).otherwise(pieces("latin"))


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form, itself in canonical form."""
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, form, attempt.cast("string")), 256)
    part = lambda i, n=256: _draw(seed, F.lit(i), n).cast("string")
    ip = F.concat_ws(".", F.when(attempt < 4, F.lit("10")).otherwise((240 + _draw(seed, F.lit(3), 15)).cast("string")), part(0), part(1), part(2))
    group = lambda i: F.lower(F.hex(_draw(seed, F.lit(i), 65536)))
    ipv6 = F.concat_ws(":", F.concat(F.lit("fd"), F.lpad(F.lower(F.hex(_draw(seed, F.lit(9), 256))), 2, "0")), *map(group, range(7)))
    drawn = _redraw(form, seed, 1)
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(form), F.lit(10)) == 0, F.concat(body, check)).otherwise(drawn)
    ssn = F.when(attempt < 8, F.concat(F.lit("9"), F.substring(_redraw(form, seed), 2, 8))).otherwise(_redraw(form, seed))
    country, account = F.substring(form, 1, 2), _redraw(F.substring(form, F.lit(5), F.length(form)), seed)
    right = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    iban = F.when(_mod97(form) == 1, right).otherwise(F.concat(F.substring(form, 1, 4), account))
    at, end = F.locate("@", form), F.regexp_extract(form, r"(\.[a-z]{2,})$", 1)
    host = F.substring(form, at + 1, F.length(form) - at - F.length(end))
    local = F.concat(F.substring(form, F.lit(1), at - 1), F.repeat(F.lit("x"), attempt))  # short addresses grow
    email = F.concat(_redraw(local, seed), F.lit("@"), _redraw(host, F.concat(seed, F.lit("@"))), end)
    kept = F.regexp_extract(form, rf"((?i: {_STREET})|(?:straße|strasse|gasse|allee|platz|weg) [0-9]+)$", 1)
    place = F.substring(form, F.lit(1), F.length(form) - F.length(kept))
    address = F.concat(_redraw(place, seed), F.when(kept.startswith(" "), kept).otherwise(F.concat(F.regexp_replace(kept, "[0-9]+$", ""), _redraw(F.regexp_extract(kept, "[0-9]+$", 0), seed))))
    out = F.when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "email", email)
    out = out.when(kind == "address", address).when(kind.isin("given-f", "given-m", "surname"), _name(kind, form, attempt, seed))
    return out.when(kind == "phone", F.concat((1 + _draw(seed, F.lit(-5), 9)).cast("string"), F.substring(drawn, F.lit(2), F.length(drawn)))).when(kind == "secret", _redraw(form, seed, 4)).otherwise(_redraw(form, seed))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, form, surrogate for a table of distinct kind and form; surrogates of a kind are distinct and no form of the table."""
    forms = store(entities.select("kind", "form"), "forms")
    table, known = forms.withColumns({"attempt": F.lit(0), "again": F.lit(True), "surrogate": F.lit(None).cast("string")}), forms.select(F.col("kind").alias("k"), F.col("form").alias("f"))
    for _ in range(MOST_ROUNDS):
        drawn = table.withColumn("surrogate", F.when(F.col("again"), surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)).otherwise(F.col("surrogate")))
        ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "form")))
        taken = ranked.join(known, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("f")), "left").withColumn("again", (F.col("rank") > 1) | F.col("f").isNotNull())
        table = store(taken.select("kind", "form", "surrogate", "again", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")), "surrogates")
        if table.where("again").isEmpty():
            return table.select("kind", "form", "surrogate")
    raise RuntimeError("too few surrogates for the entities of a kind")


def _cased(word: Column, drawn: Column) -> Column:
    """A name with the first letters of its pieces in upper case; all of them if the word is."""
    first = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
    piece = lambda p: F.when(p.rlike("^.['’]"), F.concat(F.upper(F.substring(p, 1, 2)), first(F.substring(p, F.lit(3), F.length(p))))).otherwise(first(p))
    return F.array_join(F.transform(F.split(drawn, "-"), piece), "-")


def _filled(mention: Column, drawn: Column) -> Column:
    """The letters and digits of ``drawn`` in the places and cases of those of the mention."""
    plain = lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    letters = plain(drawn)
    before = lambda i: F.length(plain(F.substring(mention, F.lit(1), i)))
    cased = lambda c, new: F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
    return F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), cased(c, F.substring(letters, before(i) + 1, F.lit(1)))).otherwise(c)), "")


def _in_format(mention: Column, kind: Column, parts: Column, drawn: Column, key: str) -> Column:
    """A mention's surrogates as the mention is written; ``drawn`` maps the place of a part to its surrogate."""
    one = F.element_at(drawn, F.lit(0))
    initial = lambda w: F.concat(_pick(F.concat(F.lit(key), w), F.lit(0), list("ABCDEFGHIJKLMNOPRSTUVW")), F.lit("."))
    words = F.transform(parts, lambda p, i: F.coalesce(_cased(p["word"], F.element_at(drawn, i)), initial(p["word"])))
    name = F.concat(F.regexp_extract(mention, LEAD, 1), F.when(mention.rlike(f"^(?:{CJK})$"), F.array_join(words, "")).otherwise(F.array_join(words, " ")), F.regexp_extract(mention, TAIL, 1))
    digits = _digits(mention)
    phone = F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(one)), one)
    as_is = F.when((mention == F.upper(mention)) & mention.rlike("[A-Z]"), F.upper(one)).otherwise(one)
    return F.when(kind == "name", name).when(kind.isin("ip", "ipv6", "email", "hex", "secret"), F.when(kind == "secret", one).otherwise(as_is)).otherwise(_filled(mention, F.when(kind == "phone", phone).otherwise(one)))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows of docs with their text rewritten, n_entities and kinds (sorted, distinct).

    Null texts stay null with no entities, as do texts without any. Repeated rows come
    back as often as they are there, rewritten alike. Columns of docs that are named
    n_entities or kinds are replaced; all others are kept. The key is needed to get the
    same surrogates again. Names count with a title, or with a listed given name before
    them. Texts without entities pass without a shuffle; no rows give no rows.
    """
    docs = docs.drop("n_entities", "kinds")
    columns = [*docs.columns, "n_entities", "kinds"]
    # marks of the text's own are written with a code, which is taken back at the end
    coded = F.replace(F.replace(F.col(text_col), F.lit(CODE), F.lit(CODE + "\u0004")), F.lit(MARK), F.lit(CODE + "\u0003"))
    own = lambda text: F.replace(F.replace(text, F.lit(CODE + "\u0003"), F.lit(MARK)), F.lit(CODE + "\u0004"), F.lit(CODE))
    marked = docs.withColumns({text_col: F.regexp_replace(coded, F.lit(PATTERN), F.lit(f"{MARK}$0{MARK}")), "_pii_row": F.monotonically_increasing_id()})
    marked = store(marked, "marked-texts")
    has = F.coalesce(F.col(text_col).contains(MARK), F.lit(False))
    plain = marked.where(~has).withColumns({text_col: own(F.col(text_col)), "n_entities": F.lit(0).cast("long"), "kinds": F.array().cast("array<string>")})

    found = marked.where(has).withColumn("_pii_pieces", F.split(text_col, MARK, -1))
    mentions = found.select("_pii_row", F.posexplode(F.filter("_pii_pieces", lambda p, i: i % 2 == 1)).alias("pos", "mention"))
    distinct = mentions.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    distinct = store(distinct.withColumn("parts", _parts(F.col("mention"), F.col("kind"))), "mentions")
    parts = distinct.select("mention", F.posexplode("parts").alias("place", "part")).select("mention", "place", F.col("part.kind").alias("kind"), F.col("part.form").alias("form")).where("form IS NOT NULL")
    drawn = parts.join(surrogates(parts.select("kind", "form").distinct(), key), ["kind", "form"])
    drawn = drawn.groupBy("mention").agg(F.map_from_entries(F.collect_list(F.struct("place", "surrogate"))).alias("drawn"))
    new = distinct.join(drawn, "mention").withColumn("new", _in_format(F.col("mention"), F.col("kind"), F.col("parts"), F.col("drawn"), key))
    told = F.when(F.col("kind") == "hex", "secret").otherwise(F.col("kind")).alias("kind")
    put = mentions.join(store(new.select("mention", told, "new"), "replacements"), "mention")

    by_row = put.groupBy("_pii_row").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("_pii_news"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    pieces = F.transform("_pii_pieces", lambda p, i: F.when(i % 2 == 1, F.get(F.col("_pii_news"), (i / 2).cast("int"))["new"]).otherwise(own(p)))
    rewritten = found.join(by_row, "_pii_row").withColumns({"n_entities": F.size("_pii_news").cast("long"), text_col: F.array_join(pieces, "")})
    return plain.select(*columns).unionByName(rewritten.select(*columns))
