"""PII surrogates in DataFrame functions only: detected entities get keyed stand-ins of their kind.

A surrogate is a function of a secret key, the kind and the normalised entity, so the same person,
address or number gets the same stand-in in every document without any exchange of text. Stand-ins
keep the format: digits, separators, letter case, country codes, check digits (cards, IBANs), titles,
gender and script of names. Mail domains end in ``.example``, addresses lie in the reserved range
240-254, social numbers start with 9.

Collision checks: the distinct entities of the corpus are grouped by stand-in (a grouped minimum). Any
but the first of those that share one, and any stand-in that is itself an entity of the corpus, are
drawn again until all are distinct; where eight draws find none free, stand-ins grow with each further
draw. Redrawn entities are few; the texts that hold one get the number of draws by a join on the digest
of the text. All other texts are rewritten in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otindex.llm.columns import fresh
from otindex.session import broadcast_if_small, materialize

#: Texts with redrawn entities up to which they are broadcast.
BROADCAST_TEXTS = 100_000

#: Draws in the format of the entity; each further one adds a character or a name, so no space stays full.
SAME_FORMAT = 8

#: Characters of an entity that one stream fills.
PIECE = 63

# Titles and common given names by gender, in two scripts.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "г-н", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Sra", "Señora", "г-жа", "госпожа")
NEUTRAL_TITLES = ("Dr", "Prof")
MALE = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew",
    "Andrew", "Peter", "Paul", "Stefan", "Jürgen", "Klaus", "Pierre", "Jacques", "François", "Carlos", "Javier", "Miguel", "Pablo",
)
FEMALE = (
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily",
    "Anna", "Laura", "Julia", "Sabine", "Ursula", "Monika", "Marie", "Claire", "Hélène", "Carmen", "Lucía", "Sofía", "Elena",
)
MALE_CYRILLIC = ("Иван", "Сергей", "Дмитрий", "Алексей", "Николай", "Павел", "Михаил", "Андрей")
FEMALE_CYRILLIC = ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана")
# Parts from which surnames are made.
HEADS = (
    "Al", "Bar", "Ber", "Bran", "Cal", "Cor", "Dal", "Del", "Dor", "El", "Fal", "Fer", "Gar", "Hal", "Har", "Hol",
    "Kel", "Kor", "Lan", "Lor", "Mal", "Mar", "Mor", "Nor", "Or", "Pel", "Ral", "Ros", "San", "Sel", "Tal", "Wal",
)
MIDDLES = (
    "a", "e", "i", "o", "ada", "ani", "ato", "eba", "edi", "ela", "eno", "era", "iba", "ido", "ila", "imo",
    "ina", "iro", "oba", "oda", "ole", "omi", "ona", "ore", "ulo", "uma", "une", "uro", "avi", "evo", "iva", "ovi",
)
TAILS = ("berg", "brand", "dale", "feld", "ford", "gard", "land", "lund", "mann", "mond", "ner", "son", "stad", "ton", "vell", "well")
HEADS_CYRILLIC = ("Бел", "Вол", "Гор", "Дан", "Зор", "Кал", "Лес", "Мир", "Нов", "Пол", "Рад", "Сол", "Тар", "Фед", "Чер", "Яр")
MIDDLES_CYRILLIC = ("ан", "ат", "ев", "ем", "ен", "ер", "ид", "ик", "ин", "од", "ок", "ол", "он", "ор", "ув", "ун")

_WORD = r"\p{Lu}[\p{L}'’-]{1,40}"
_TITLE = "(?:" + "|".join((*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES)) + ")"
_GIVEN = "(?:" + "|".join((*MALE, *FEMALE, *MALE_CYRILLIC, *FEMALE_CYRILLIC)) + ")"

#: What is detected, tried in this order at every place of a text. Repetitions are bounded or
#: possessive, so a long text takes linear time.
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![\w-])",
    "secret": r"(?i:(?<![\w-])(?:password|passwd|pwd|token|secret|api[_-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?)[!-~&&[^\"',;]]{6,}+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\w|\.[0-9])",
    "card": r"(?<![\w.+-])[3-6][0-9]{3}(?:[ -]?[0-9]){9,15}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?!\w)",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}\.?[ ]{_WORD}(?:[ ]{_WORD})?|{_GIVEN}[ ]{_WORD})(?![\p{{L}}\p{{N}}])",
}
#: Nothing begins after an ASCII letter or digit: one look settles most places of a text.
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(entity: Column) -> Column:
    """The kind of a detected string: the first whose pattern covers all of it."""
    cases = F
    for name, pattern in KINDS.items():
        cases = cases.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name))
    return cases


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _fold(text: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Runs ``step(state, position)`` over the positions 1, 2, ... of a non-empty text."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), start, step)


def _at(text: Column, position: Column, size: int = 1) -> Column:
    return F.substring(text, position, F.lit(size))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""

    def step(reverse: Column, total: Column, k: Column) -> Column:
        d = _at(reverse, k).cast("int")
        return (total + F.when(k % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)) % 10

    return let(F.reverse(digits), lambda r: _fold(r, F.lit(0), lambda total, k: step(r, total, k)))


def mod97(value: Column) -> Column:
    """Letters A-Z count as 10 to 35; the number that results, modulo 97."""

    def step(text: Column, total: Column, k: Column) -> Column:
        c = _at(text, k)
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + letter) % 97)

    return let(value, lambda text: _fold(text, F.lit(0), lambda total, k: step(text, total, k)))


class Surrogates:
    """Stand-ins under a key, as column expressions."""

    def __init__(self, key: str):
        self.key = F.lit(key)

    def stream(self, kind: str, norm: Column, draw: Column) -> Column:
        """256 hexadecimal digits that only the key, kind, entity and draw decide."""
        seed = F.concat_ws("\x1f", self.key, F.lit(kind), norm, draw.cast("string"))
        return F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{k}")), 256) for k in range(4)))

    @staticmethod
    def number(stream: Column, k: Column | int, below: Column | int) -> Column:
        """The k-th number of a stream, in [0, below)."""
        k = F.lit(k) if isinstance(k, int) else k
        return F.conv(_at(stream, (k * 4) % 253 + 1, 4), 16, 10).cast("int") % below

    def scrambled(self, text: Column, stream: Column) -> Column:
        """Letters become letters of the same case, digits digits; the rest stays. Hex stays hex.

        Long texts are taken in pieces, each with a stream of its own, in linear time.
        """
        digit, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"

        def filled(x: Column) -> Column:
            """A piece of 1 to PIECE characters."""

            def step(out: Column, k: Column) -> Column:
                c = _at(x["text"], k)
                alphabet = (
                    F.when(x["hex"], digit + lower[:6])
                    .when(c.rlike("[0-9]"), digit)
                    .when(c.rlike("[a-z]"), lower)
                    .when(c.rlike("[A-Z]"), lower.upper())
                    .otherwise(c)
                )
                return F.concat(out, let(alphabet, lambda a: _at(a, self.number(x["stream"], k, F.length(a)) + 1)))

            return _fold(x["text"], F.lit(""), step)

        hexadecimal = text.rlike("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{8,}$")

        def piece(x: Column, part: Column, k: Column) -> Column:
            own = F.concat(*(F.sha2(F.concat_ws("\x1f", x["stream"], k.cast("string"), F.lit(str(j))), 256) for j in range(4)))
            own = F.when(k == 0, x["stream"]).otherwise(own)
            return let(F.struct(part.alias("text"), own.alias("stream"), x["hex"].alias("hex")), filled)

        def whole(x: Column) -> Column:
            parts = F.regexp_extract_all(x["text"], F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
            long = F.array_join(F.transform(parts, lambda part, k: piece(x, part, k)), "")
            return F.when(x["text"] == "", x["text"]).when(F.length(x["text"]) <= PIECE, filled(x)).otherwise(long)

        return let(F.struct(text.alias("text"), stream.alias("stream"), hexadecimal.alias("hex")), whole)

    @staticmethod
    def placed(entity: Column, characters: Column) -> Column:
        """``entity`` with its letters and digits replaced, one after the other, by ``characters``.

        Characters beyond those of the entity follow at its end.
        """
        places = F.length(F.regexp_replace(entity, "[^0-9A-Za-z]", ""))

        def step(new: Column, out: Column, k: Column) -> Column:
            before = F.length(F.regexp_replace(out, "[^0-9A-Za-z]", ""))
            return let(
                _at(entity, k),
                lambda c: F.concat(out, F.when(c.rlike("[0-9A-Za-z]"), _at(new, before + 1)).otherwise(c)),
            )

        def all_of(new: Column) -> Column:
            rest = F.substring(new, places + 1, F.length(new))
            return F.concat(_fold(entity, F.lit(""), lambda out, k: step(new, out, k)), rest)

        return let(characters, all_of)

    def more(self, kind: str, norm: Column, draw: Column, like: str = "0") -> Column:
        """What a stand-in gets beyond the format: characters such as ``like``, one more with each draw."""
        new = let(F.repeat(F.lit(like), draw - (SAME_FORMAT - 1)), lambda x: self.scrambled(x, self.stream(f"{kind}+", norm, draw)))
        return F.when(draw < SAME_FORMAT, "").otherwise(new)

    # --- normalised stand-ins, one per kind: what collision checks compare ---

    def email(self, norm: Column, draw: Column) -> Column:
        local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
        labels = F.regexp_replace(domain, r"\.[^.]*$", "")
        own, shared = self.stream("email", norm, draw), self.stream("domain", domain, F.lit(0))
        local = F.concat(self.scrambled(local, own), self.more("email", norm, draw, "a"))
        return F.concat(local, F.lit("@"), self.scrambled(labels, shared), F.lit(".example"))

    def ip(self, norm: Column, draw: Column) -> Column:
        def octets(s: Column) -> Column:
            parts = [self.number(s, 0, 15) + 240, *(self.number(s, k, 256) for k in (1, 2, 3))]
            further = F.transform(F.sequence(F.lit(4), draw - (SAME_FORMAT - 4)), lambda k: self.number(s, k, 256).cast("string"))
            further = F.when(draw >= SAME_FORMAT, F.array_join(further, "."))
            return F.concat_ws(".", *(p.cast("string") for p in parts), further)

        return let(self.stream("ip", norm, draw), octets)

    def card(self, norm: Column, draw: Column) -> Column:
        body = F.concat(_at(norm, F.lit(1)), self.scrambled(F.substring(norm, F.lit(2), F.length(norm) - 2), self.stream("card", norm, draw)), self.more("card", norm, draw))
        return let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))

    def ssn(self, norm: Column, draw: Column) -> Column:
        rest = self.scrambled(F.substring(norm, F.lit(2), F.lit(8)), self.stream("ssn", norm, draw))
        return F.concat(F.lit("9"), rest, self.more("ssn", norm, draw))

    def phone(self, norm: Column, draw: Column) -> Column:
        def drawn(s: Column) -> Column:
            rest = self.scrambled(F.substring(norm, F.lit(2), F.length(norm)), s)
            return F.concat((self.number(s, 0, 8) + 2).cast("string"), rest, self.more("phone", norm, draw))

        return let(self.stream("phone", norm, draw), drawn)

    def iban(self, norm: Column, draw: Column) -> Column:
        country, account = _at(norm, F.lit(1), 2), F.substring(norm, F.lit(5), F.length(norm))

        def checked(new: Column) -> Column:
            check = 98 - mod97(F.concat(new, country, F.lit("00")))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

        new = F.concat(self.scrambled(account, self.stream("iban", norm, draw)), self.more("iban", norm, draw))
        return let(new, checked)

    def secret(self, norm: Column, draw: Column) -> Column:
        return F.concat(self.scrambled(norm, self.stream("secret", norm, draw)), self.more("secret", norm, draw, "a"))

    def api_key(self, norm: Column, draw: Column) -> Column:
        prefix = F.regexp_extract(norm, "^(?:AKIA|gh[pousr]_|sk-|xox[abprs]-)", 0)
        rest = self.scrambled(F.substring(norm, F.length(prefix) + 1, F.length(norm)), self.stream("key", norm, draw))
        return F.concat(prefix, rest, self.more("key", norm, draw, "a"))

    def name(self, kind: str, names: tuple[str, ...]) -> Callable[[Column, Column], Column]:
        """A given name from a list; from the second draw on two joined by a hyphen, from the ninth three and one more each."""
        values = F.array(*map(F.lit, names))

        def chosen(s: Column, draw: Column) -> Column:
            size = F.when(draw == 0, 1).when(draw < SAME_FORMAT, 2).otherwise(draw - (SAME_FORMAT - 3))
            joined = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.element_at(values, self.number(s, k, len(names)) + 1))
            return F.array_join(joined, "-")

        return lambda norm, draw: let(self.stream(kind, norm, draw), lambda s: chosen(s, draw))

    def surname(self, kind: str, heads: tuple, middles: tuple, tails: tuple) -> Callable[[Column, Column], Column]:
        """A made-up surname; from the ninth draw on two joined by a hyphen, and one more each."""

        lists = [F.array(*map(F.lit, x)) for x in (heads, middles, tails)]

        def one(s: Column, k: Column) -> Column:
            return F.concat(*(F.element_at(x, self.number(s, k + i, F.size(x)) + 1) for i, x in enumerate(lists)))

        def chosen(s: Column, draw: Column) -> Column:
            last = F.when(draw < SAME_FORMAT, 0).otherwise(draw - (SAME_FORMAT - 1))
            return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda k: one(s, k * 3)), "-")

        return lambda norm, draw: let(self.stream(kind, norm, draw), lambda s: chosen(s, draw))

    def makers(self) -> dict[str, Callable[[Column, Column], Column]]:
        """The stand-in of a normalised entity by kind; names are several kinds."""
        return {
            "email": self.email, "secret": self.secret, "key": self.api_key, "iban": self.iban, "ip": self.ip,
            "card": self.card, "ssn": self.ssn, "phone": self.phone,
            "male": self.name("male", MALE), "female": self.name("female", FEMALE),
            "male_cyrillic": self.name("male_cyrillic", MALE_CYRILLIC),
            "female_cyrillic": self.name("female_cyrillic", FEMALE_CYRILLIC),
            "surname": self.surname("surname", HEADS, MIDDLES, TAILS),
            "surname_male": self.surname("surname_male", HEADS_CYRILLIC, MIDDLES_CYRILLIC, ("ов", "ев", "ин", "енков")),
            "surname_female": self.surname("surname_female", HEADS_CYRILLIC, MIDDLES_CYRILLIC, ("ова", "ева", "ина", "енкова")),
        }


def _norm(kind: Column, entity: Column) -> Column:
    """The form in which spellings of one entity agree; null for persons, whose names count apart."""
    def national(digits: Column) -> Column:
        country = F.when(digits.rlike("^[17]"), 1).otherwise(2)
        last_ten = F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10))
        abroad = entity.startswith("+") & (F.length(digits) <= 10)
        return F.when(abroad, F.substring(digits, country + 1, F.length(digits))).otherwise(last_ten)

    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind.isin("card", "ssn"), _digits(entity))
        .when(kind == "phone", let(_digits(entity), national))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "secret", F.regexp_extract(entity, r"^[^=:]*[=:][ ]*[\"']?(.*)$", 1))
        .when(kind != "person", entity)
    )


_CYRILLIC = r"\p{IsCyrillic}"


def _person(entity: Column) -> tuple[Column, Column, Column]:
    """Title with its blank (or empty), given name (or empty) and surname of a detected person."""
    title = F.regexp_extract(entity, rf"^{_TITLE}\.?[ ]", 0)
    names = F.substring(entity, F.length(title) + 1, F.length(entity))
    return title, F.regexp_extract(names, "^(.*) ", 1), F.substring_index(names, " ", -1)


def _described(entity: Column) -> Column:
    """struct of a detected string, its kind, norm, title, given name, surname and the kinds of names."""
    return let(
        let(entity, lambda e: F.struct(e.alias("text"), _kind(e).alias("kind"))),
        lambda x: F.when(x["kind"] == "person", _person(x["text"])).otherwise(
            let(
                _norm(x["kind"], x["text"]),
                lambda norm: F.struct(
                    x["text"].alias("text"),
                    # Cards must fit Luhn.
                    F.when((x["kind"] != "card") | (luhn(F.when(x["kind"] == "card", norm).otherwise("0")) == 0), x["kind"]).alias("kind"),
                    norm.alias("norm"),
                    *(F.lit("").alias(c) for c in ("title", "given", "surname", "given_kind", "surname_kind")),
                ),
            )
        ),
    )


def _person(entity: Column) -> Column:
    """The description of a person: title with its blank, names, and their kinds by title and script."""

    def kinds(x: Column) -> Column:
        bare, known = F.regexp_replace(x["title"], r"\.?[ ]$", ""), F.initcap(x["given"])
        female = (
            F.when(bare.isin(*FEMALE_TITLES), True)
            .when(bare.isin(*MALE_TITLES), False)
            .when(known.isin(*FEMALE, *FEMALE_CYRILLIC), True)
            .when(known.isin(*MALE, *MALE_CYRILLIC), False)
            .otherwise(x["surname"].rlike("(?:ова|ева|ина|ая)$"))
        )
        script = F.when(x["given"].rlike(_CYRILLIC), "_cyrillic").otherwise("")
        surname = F.when(female, "surname_female").otherwise("surname_male")
        return F.struct(
            x["text"].alias("text"), F.lit("person").alias("kind"), F.lit(None).cast("string").alias("norm"),
            x["title"].alias("title"), x["given"].alias("given"), x["surname"].alias("surname"),
            F.concat(F.when(female, "female").otherwise("male"), script).alias("given_kind"),
            F.when(x["surname"].rlike(_CYRILLIC), surname).otherwise("surname").alias("surname_kind"),
        )

    def split(title: Column) -> Column:
        names = F.substring(entity, F.length(title) + 1, F.length(entity))
        return F.struct(
            entity.alias("text"),
            title.alias("title"),
            F.regexp_extract(names, "^(.*) ", 1).alias("given"),
            F.substring_index(names, " ", -1).alias("surname"),
        )

    return let(let(F.regexp_extract(entity, rf"^{_TITLE}\.?[ ]", 0), split), kinds)


def _parts(found: Column) -> Column:
    """array<struct<kind, norm>>: what of a described string gets a stand-in."""

    def part(kind: Column, norm: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"))

    names = F.array(
        part(found["given_kind"], F.lower(found["given"])), part(found["surname_kind"], F.lower(found["surname"]))
    )
    none = F.expr("cast(array() as array<struct<kind:string,norm:string>>)")
    return (
        F.when(found["kind"] == "person", F.filter(names, lambda p: p["norm"] != ""))
        .when(found["kind"].isNotNull(), F.array(part(found["kind"], found["norm"])))
        .otherwise(none)
    )


def _case_like(new: Column, old: Column) -> Column:
    capitals = (F.upper(old) == old) & (F.length(old) > 1) & (F.lower(old) != old)
    return let(new, lambda n: F.when(capitals, F.upper(n)).otherwise(n))


def _rewritten(found: Column, makers: dict, draws: Callable[[Column, Column], Column]) -> Column:
    """A described string with its stand-ins in place."""
    entity, kind, norm = found["text"], found["kind"], found["norm"]

    def made(name: str, n: Column) -> Column:
        return let(draws(F.lit(name), n), lambda draw: makers[name](n, draw))

    def chosen(of: str, text: str, *names: str) -> Column:
        new = let(F.lower(found[text]), lambda n: reduce(lambda c, name: c.when(found[of] == name, made(name, n)), names, F))
        return _case_like(new, found[text])

    given = chosen("given_kind", "given", "male", "female", "male_cyrillic", "female_cyrillic")
    surname = chosen("surname_kind", "surname", "surname", "surname_male", "surname_female")
    name = F.concat(found["title"], F.when(found["given"] == "", "").otherwise(F.concat(given, F.lit(" "))), surname)
    before = F.substring(entity, F.lit(1), F.length(entity) - F.length(norm))
    abroad = let(_digits(entity), lambda d: F.substring(d, F.lit(1), F.length(d) - F.length(norm)))
    place = Surrogates.placed
    return (
        F.when(kind == "email", _case_like(made("email", norm), entity))
        .when(kind == "secret", F.concat(before, made("secret", norm)))
        .when(kind == "key", made("key", norm))
        .when(kind == "iban", place(entity, made("iban", norm)))
        .when(kind == "ip", made("ip", norm))
        .when(kind == "card", place(entity, made("card", norm)))
        .when(kind == "ssn", place(entity, made("ssn", norm)))
        .when(kind == "phone", place(entity, F.concat(abroad, made("phone", norm))))
        .when(kind == "person", name)
        .otherwise(entity)
    )


def detected(text: Column) -> Column:
    """All detected strings of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def find_entities(documents: DataFrame) -> DataFrame:
    """Distinct (kind, norm) of all texts."""
    found = documents.where(F.col("text").rlike(PATTERN)).select(F.explode(F.array_distinct(detected(F.col("text")))).alias("entity"))
    return found.distinct().select(F.explode(let(_described(F.col("entity")), _parts)).alias("part")).select("part.*").distinct()


def _made(makers: dict, draw: Column) -> Column:
    return reduce(lambda cases, item: cases.when(F.col("kind") == item[0], item[1](F.col("norm"), draw)), makers.items(), F)


def redrawn(entities: DataFrame, makers: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(kind, norm, draw) of the entities whose first stand-in is taken, with the draw that is free.

    A stand-in is taken if it equals an entity of its kind, or that of an entity earlier in order. Spaces
    of stand-ins grow with the draw, so the rounds come to an end however many entities there are.
    ``entities`` is (kind, norm), distinct.
    """
    entities = materialize(entities)
    settled = materialize(entities.withColumn("draw", F.lit(0)).withColumn("new", _made(makers, F.lit(0))))
    held = entities.select("kind", F.lower("norm").alias("new"))
    for draw in count(1):
        lowered = settled.withColumn("new", F.lower("new"))
        first = lowered.groupBy("kind", "new").agg(F.min(F.struct("draw", "norm")).alias("first"))
        later = lowered.join(first, ["kind", "new"]).where(F.col("norm") != F.col("first.norm")).select("kind", "norm")
        again = materialize(later.union(lowered.join(held, ["kind", "new"], "left_semi").select("kind", "norm")).distinct())
        if not again.limit(1).count():
            return settled.where("draw > 0").select("kind", "norm", "draw")
        moved = again.withColumn("draw", F.lit(draw)).withColumn("new", _made(makers, F.lit(draw)))
        settled = materialize(settled.join(again, ["kind", "norm"], "left_anti").unionByName(moved))


def pseudonymize(documents: DataFrame, key: str) -> DataFrame:
    """``documents`` with every detected entity of the texts replaced, in their own columns.

    Texts without entities, null and empty ones come back unchanged; repeated rows stay, and equal
    entities get equal stand-ins everywhere. Other columns are left alone.
    """
    makers = Surrogates(key).makers()
    draws = materialize(redrawn(find_entities(documents), makers))
    text, names = F.col("text"), documents.columns

    def replaced(lookup: Callable[[Column, Column], Column]) -> Column:
        between = F.split(text, PATTERN, -1)
        new = F.transform(detected(text), lambda e: let(_described(e), lambda x: _rewritten(x, makers, lookup)))
        joined = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(text.rlike(PATTERN), joined).otherwise(text)

    def columns(new_text: Column) -> list[Column]:
        return [new_text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names]

    if not draws.limit(1).count():
        return documents.select(*columns(replaced(lambda kind, norm: F.lit(0))))

    digest, column = fresh(documents, "digest"), fresh(documents, "draws")
    holding = documents.where(text.rlike(PATTERN)).select(F.sha2(text, 256).alias(digest), "text").dropDuplicates([digest])
    found = F.flatten(F.transform(detected(text), lambda e: let(_described(e), _parts)))
    pair = F.struct(F.concat_ws("|", "part.kind", "part.norm").alias("name"), "draw")
    by_text = (
        holding.select(digest, F.explode(F.array_distinct(found)).alias("part"))
        .select(digest, "part", F.col("part.kind").alias("kind"), F.col("part.norm").alias("norm"))
        .join(draws, ["kind", "norm"])
        .groupBy(digest)
        .agg(F.map_from_entries(F.collect_list(pair)).alias(column))
    )
    by_text = broadcast_if_small(materialize(by_text), BROADCAST_TEXTS)
    marked = documents.withColumn(digest, F.sha2(text, 256)).join(by_text, digest, "left")

    def lookup(kind: Column, norm: Column) -> Column:
        return F.coalesce(F.element_at(F.col(column), F.concat_ws("|", kind, norm)), F.lit(0))

    return marked.select(*columns(replaced(lookup)))
