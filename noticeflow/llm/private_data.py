"""PII: validated numbers and dates are replaced by keyed permutations within their format.

Native expressions only. A text is cut at everything that looks like personal data; each piece is
validated (Luhn sum, octets up to 255, an existing date, ...) and, if valid, permuted by a Feistel
network over its digits: alternating halves, a keyed SHA-256 as round function. The same value
gets the same pseudonym in every document, different values of a kind get different ones, and
separators stay. E-mail addresses, which have no number format, get a keyed digest as local part.

A card often stands beside other numbers (an expiry date, a security code, a leading number), so
its digits are read in three steps, each on what the steps before left over: the usual groupings
and whole runs of 13-19 digits, the other kinds, then any 13-19 digits between group boundaries.
Only readings with a valid Luhn sum are cut out; a usual grouping is preferred to a longer run.

Kinds: card (13-19 digits, Luhn; the check digit is made anew), phone (10 digits, country code
kept), ip, ssn, date (year-month-day, day/month/year or month/day/year; permuted within its
century block 1870-1969 or 1970-2069, earlier and later ones within cycles of 400 years), email.

A run of letters, however long, is tried from its first character only; the time per text grows
with its length (and with its number of different cards).

Defined cases: null text stays null, empty text stays empty; texts without digit or @ are passed
on as they are; invalid numbers stay; repeated rows are treated each; an empty table gives an
empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: What looks like personal data, longest formats first. Fixed values.
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9A-Za-z-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?=T[0-9]{2}|(?![0-9A-Za-z-]))"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
)
OTHERS = "|".join(p for kind, p in PATTERNS if kind != "card")

#: Ends of a card; a number in the last 64 characters of a local part belongs to the address.
_LEFT, _RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z]|[A-Za-z0-9._%+-]{0,64}+@)"
#: At least 13 digits that stand together.
DENSE = r"[0-9](?:[ -]?[0-9]){12}"
#: 4-4-4-4, 4-6-5, 4-6-4 and undivided.
GROUPED = rf"{_LEFT}(?=((?:[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{4,5}}|[0-9]{{13,19}}){_RIGHT}))"
#: A run that no other digits touch.
WHOLE = rf"{_LEFT}(?<![0-9][ -])([0-9](?:[ -]?[0-9]){{12,18}})(?![ -]?[0-9]|[A-Za-z]|[A-Za-z0-9._%+-]{0,64}+@)"
#: Every reading of one length that begins and ends with a group.
READING = (rf"{_LEFT}(?=([0-9](?:[ -]?[0-9]){{", rf"}}{_RIGHT}))")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(left: str, right: str, left_size: str, right_size: str, key: str, label: str) -> str:
    """SQL struct (a, b): (left, right) permuted within left_size x right_size.

    A fold keeps the expression small; after an even number of rounds both halves stand in
    their places again.
    """
    mixed = f"cast(conv(substr(sha2(concat_ws(':', {_text(key)}, {label}, r, s.b), 256), 1, 15), 16, 10) AS decimal(20,0))"
    return (
        f"aggregate(sequence(1, {ROUNDS}), "
        f"named_struct('a', cast({left} AS bigint), 'b', cast({right} AS bigint), 'm', cast({left_size} AS bigint), 'k', cast({right_size} AS bigint)), "
        f"(s, r) -> named_struct('a', s.b, 'b', cast(pmod(cast(s.a AS decimal(20,0)) + {mixed}, cast(s.m AS decimal(20,0))) AS bigint), 'm', s.k, 'k', s.m))"
    )


def _digits(value: str, key: str, label: str) -> str:
    """Permuted digit string of the same length (2 to 18)."""
    half = f"(length({value}) div 2)"
    pair = feistel(
        f"substr({value}, 1, {half})", f"substr({value}, {half} + 1)", f"pow(10, {half})", f"pow(10, length({value}) - {half})", key, f"concat({_text(label)}, length({value}))"
    )
    return f"transform(array({pair}), p -> concat(lpad(cast(p.a AS string), {half}, '0'), lpad(cast(p.b AS string), length({value}) - {half}, '0')))[0]"


def _luhn(value: str, start: int) -> str:
    """Weighted digit sum from the right; start 1 doubles the last digit."""
    digit = f"cast(substr({value}, length({value}) - i, 1) AS int)"
    return f"aggregate(sequence(0, length({value}) - 1), 0, (t, i) -> t + if((i + {start}) % 2 = 1, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}), {digit}))"


def _refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    return (
        f"aggregate(split({shape}, ''), named_struct('o', '', 'i', 1), (s, c) -> if(c rlike '^[0-9]$', "
        f"named_struct('o', concat(s.o, substr({digits}, s.i, 1)), 'i', s.i + 1), named_struct('o', concat(s.o, c), 'i', s.i)), s -> s.o)"
    )


def _with(name: str, value: str, body: str) -> str:
    """Compute a value once inside an expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _card(m: str, key: str) -> str:
    new = _with("h", _digits("substr(d, 1, length(d) - 1)", key, "card"), f"concat(h, cast((10 - {_luhn('h', 1)} % 10) % 10 AS string))")
    return _with("d", f"regexp_replace({m}, '[^0-9]', '')", f"if({_luhn('d', 0)} % 10 = 0, {_with('n', new, _refill(m, 'n'))}, {m})")


def _phone(m: str, key: str) -> str:
    tail = f"regexp_extract({m}, {_text(r'(?:[(][0-9]{3}[)][ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$')}, 0)"
    new = _with("n", _digits("regexp_replace(t, '[^0-9]', '')", key, "phone"), _refill("t", "n"))
    return _with("t", tail, f"concat(substr({m}, 1, length({m}) - length(t)), {new})")


def _ip(m: str, key: str) -> str:
    octets = f"transform(split({m}, '[.]'), x -> cast(x AS int))"
    pair = feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", key, "'ip'")
    shown = "concat_ws('.', p.a div 256, p.a % 256, p.b div 256, p.b % 256)"
    return _with("o", octets, f"if(exists(o, x -> x > 255), {m}, {_with('p', pair, shown)})")


def _ssn(m: str, key: str) -> str:
    valid = f"NOT ({m} rlike '^(000|666|9)' OR {m} rlike '-00-' OR {m} rlike '-0000$')"
    new = _with("n", _digits(f"regexp_replace({m}, '-', '')", key, "ssn"), _refill(m, "n"))
    return f"if({valid}, {new}, {m})"


#: First year of a block, its last year, and two factors whose product is its number of days.
#: Outside the two blocks of a hundred years, whole cycles of 400 years and what is left of one.
CENTURIES = ((1970, 2069, 75, 487), (1870, 1969, 92, 397))
CYCLE, CYCLE_DAYS = 400, (189, 773)
ENDS = ((1, 269, 250, 393), (9670, 9999, 43, 2803))


def _block(year: str) -> str:
    """SQL struct (first, low, high) of the block that holds a year; null outside 1-9999."""
    row = "named_struct('first', make_date({}, 1, 1), 'low', {}, 'high', {})".format
    cases = [f"WHEN {year} BETWEEN {one} AND {last} THEN {row(one, low, high)}" for one, last, low, high in CENTURIES + ENDS]
    early, late = ENDS[0][1] + 1, CENTURIES[0][1] + 1
    cases += [f"WHEN {year} BETWEEN {since} AND {until} THEN {row(f'cast({since} + ({year} - {since}) div {CYCLE} * {CYCLE} AS int)', *CYCLE_DAYS)}"
              for since, until in ((early, CENTURIES[1][0] - 1), (late, ENDS[1][0] - 1))]
    return f"CASE {' '.join(cases)} END"


def _date(m: str, key: str) -> str:
    day = f"coalesce(try_to_date({m}, 'yyyy-MM-dd'), try_to_date(translate({m}, '.', '/'), 'dd/MM/yyyy'), try_to_date(translate({m}, '.', '/'), 'MM/dd/yyyy'))"
    layout = f"if({m} rlike '^[0-9]{{4}}-', 'yyyy-MM-dd', if(try_to_date(translate({m}, '.', '/'), 'dd/MM/yyyy') IS NOT NULL, 'dd/MM/yyyy', 'MM/dd/yyyy'))"
    number = "datediff(y, k.first)"
    pair = feistel(f"{number} div k.high", f"{number} % k.high", "k.low", "k.high", key, "concat('date', cast(k.first AS string))")
    moved = _with("p", pair, f"date_format(date_add(k.first, cast(p.a * k.high + p.b AS int)), {layout})")
    shown = f"if({m} rlike '[.]', translate({moved}, '/', '.'), {moved})"
    return _with("y", day, _with("k", _block("year(y)"), f"if(k IS NULL, {m}, {shown})"))


def _email(m: str, key: str) -> str:
    return f"concat('u', substr(sha2(concat_ws(':', {_text(key)}, 'email', lower({m})), 256), 1, 12), '@', regexp_replace({m}, '^.*@', ''))"


def pseudonym(m: str, key: str) -> str:
    """SQL expression for one piece: its pseudonym, or itself if it is not valid."""
    makers = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
    cases = " ".join(f"WHEN {m} rlike {_text(f'^(?:{p})$')} THEN {makers[kind](m, key)}" for kind, p in PATTERNS)
    return f"CASE {cases} ELSE {m} END"


def _cut(value: str, pattern: str) -> str:
    """Pieces of a text: gaps (p false) and what the pattern finds (p true)."""
    gap, hit = "named_struct('p', false, 's', g)", "named_struct('p', true, 's', m)"
    return f"flatten(zip_with(split({value}, {pattern}, -1), regexp_extract_all({value}, {pattern}, 0), (g, m) -> if(m IS NULL, array({gap}), array({gap}, {hit}))))"


def _cut_cards(value: str, cards: str) -> str:
    """Pieces of a text at the card numbers of a list."""
    whole = f"array(named_struct('p', false, 's', {value}))"
    pattern = f"concat({_text(_LEFT + '(?:')}, array_join(cards, '|'), {_text(')' + _RIGHT)})"
    return _with("cards", cards, f"if(size(cards) = 0, {whole}, {_with('pattern', pattern, _cut(value, 'pattern'))})")


def _valid(readings: str) -> str:
    return f"filter(array_distinct({readings}), c -> {_with('d', _digits_of('c'), _luhn('d', 0) + ' % 10 = 0')})"


def _digits_of(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _plain_cards(value: str) -> str:
    """Valid cards in a usual grouping, and valid whole runs that hold none of them."""
    grouped, whole = (_valid(f"regexp_extract_all({value}, {_text(p)}, 1)") for p in (GROUPED, WHOLE))
    return _with("grouped", grouped, f"concat(grouped, filter({whole}, w -> NOT exists(grouped, c -> w <> c AND contains(w, c)) AND NOT array_contains(grouped, w)))")


def _other_cards(value: str) -> str:
    """Valid cards between any two group boundaries, longest first."""
    head, tail = map(_text, READING)
    return _valid(f"flatten(transform(sequence(18, 12), k -> regexp_extract_all({value}, concat({head}, k, {tail}), 1)))")


def pseudonymised(text: str, key: str) -> Column:
    """The text with every valid number, date and address replaced."""
    dense = lambda value: f"{value} rlike {_text(DENSE)}"
    whole = lambda value: f"array(named_struct('p', false, 's', {value}))"
    plain = f"if({dense(text)}, {_cut_cards(text, _plain_cards(text))}, {whole(text)})"
    others = f"flatten(transform({plain}, e -> if(e.p, array(e), {_cut('e.s', _text(OTHERS))})))"
    rest = f"flatten(transform({others}, e -> if(NOT e.p AND {dense('e.s')}, {_cut_cards('e.s', _other_cards('e.s'))}, array(e))))"
    joined = f"array_join(transform({rest}, e -> {_with('m', 'e.s', f'if(e.p, {pseudonym("m", key)}, m)')}), '')"
    return F.expr(f"CASE WHEN {text} rlike '[0-9@]' THEN {joined} ELSE {text} END")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All columns with ``text`` pseudonymised, and ``changed``: whether anything was replaced."""
    made = docs.withColumn("__made", pseudonymised("text", key))
    return made.withColumns({"changed": ~F.col("text").eqNullSafe(F.col("__made")), "text": F.col("__made")}).drop("__made")
