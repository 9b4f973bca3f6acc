"""The corpus problems' functions as Spark SQL expressions: {0}, {1}, ... are the arguments.

``call(name, *columns)`` gives the column; H numbers are the problems'. Arrays are
ARRAY<BIGINT>, ARRAY<DOUBLE> or ARRAY<STRING>, pairs structs (a, b). A value used
more than once inside a lambda is bound first (``let``), so it is computed once.
The few that need unbounded search or a stack run as Arrow UDFs (``UDFS``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def prime(x: str) -> str:
    return f"({x} > 1 AND forall(sequence(2L, greatest(2L, CAST(floor(sqrt(greatest({x}, 0))) AS BIGINT))), pd -> pd >= {x} OR {x} % pd <> 0))"


def chars(s: str) -> str:
    return f"filter(split({s}, ''), ch -> ch <> '')"


def upto(n: str, least: str = "1") -> str:
    """least..n, empty if n is smaller."""
    return f"CASE WHEN {n} >= {least} THEN sequence(CAST({least} AS BIGINT), CAST({n} AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END"


def index(a: str) -> str:
    return upto(f"size({a}) - 1", "0")


def digit_sum(x: str) -> str:
    return f"aggregate({chars(f'CAST(abs({x}) AS STRING)')}, 0L, (da, dd) -> da + CAST(dd AS BIGINT))"


def signed_digit_sum(x: str) -> str:
    return f"({digit_sum(x)} - CASE WHEN {x} < 0 THEN 2 * CAST(left(CAST(abs({x}) AS STRING), 1) AS BIGINT) ELSE 0 END)"


def total(a: str, zero: str = "0L") -> str:
    return f"aggregate({a}, {zero}, (ta, tx) -> ta + tx)"


def binary(x: str) -> str:
    return f"bin({x})"


def ordered(a: str, before: str) -> str:
    """Sorted by a comparison of l and r."""
    return f"array_sort({a}, (l, r) -> {before})"


def by_key(key) -> str:
    """-1, 0, 1 by a key expression, stable order being the caller's."""
    return f"CASE WHEN {key('l')} < {key('r')} THEN -1 WHEN {key('l')} > {key('r')} THEN 1 ELSE 0 END"


def stable(a: str, key) -> str:
    """The array sorted by a key, ties in their order."""
    return f"transform(array_sort(transform({a}, (x, i) -> struct({key('x')} AS k, i AS i, x AS x))), p -> p.x)"


BALANCE = "aggregate({c}, struct(0 AS d, true AS ok), (a, x) -> struct(a.d + CASE WHEN x = '{o}' THEN 1 WHEN x = '{e}' THEN -1 ELSE 0 END AS d, a.ok AND a.d + CASE WHEN x = '{o}' THEN 1 WHEN x = '{e}' THEN -1 ELSE 0 END >= 0 AS ok), a -> a.ok AND a.d = 0)"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shifted(n: int) -> str:
    return LOWER[n % 26 :] + LOWER[: n % 26]


#: Small tables of the problems.
NUMERALS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
NOTES = {"o": 4, "o|": 2, ".|": 1}
PLANETS = ["Mercury", "Venus", "Earth", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune"]
GRADES = [(4.0, "A+"), (3.7, "A"), (3.3, "A-"), (3.0, "B+"), (2.7, "B"), (2.3, "B-"), (2.0, "C+"), (1.7, "C"), (1.3, "C-"), (1.0, "D+"), (0.7, "D"), (0.0, "D-")]
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
_WORDS = "array('" + "', '".join(NUMERALS) + "')"
_PLANETS = "array('" + "', '".join(PLANETS) + "')"


def recurrence(first: list[int], step: str, n: str) -> str:
    """The n-th of a sequence that begins with ``first``; step combines the last ones, p[0] the oldest."""
    k = len(first)
    start = "array(" + ", ".join(f"{x}L" for x in first) + ")"
    return f"CASE WHEN {n} < {k} THEN get({start}, CAST({n} AS INT)) ELSE element_at(aggregate({upto(n, str(k))}, {start}, (p, i) -> array_append(slice(p, 2, {k - 1}), {step})), -1) END"


SQL: dict[str, str] = {
    "has_close_elements": let("s", "array_sort({0})", f"exists({upto('size(s) - 1')}, i -> get(s, CAST(i AS INT)) - get(s, CAST(i AS INT) - 1) < {{1}})"),
    "truncate_number": "{0} % 1",
    "below_zero": "aggregate({0}, struct(0L AS s, false AS b), (a, x) -> struct(a.s + x AS s, a.b OR a.s + x < 0 AS b), a -> a.b)",
    "mean_absolute_deviation": let("m", f"{total('{0}', '0D')} / size({{0}})", "aggregate({0}, 0D, (a, x) -> a + abs(x - m)) / size({0})"),
    "intersperse": "slice(flatten(transform({0}, x -> array(x, {1}))), 1, greatest(2 * size({0}) - 1, 0))",
    "parse_nested_parens": f"transform(filter(split({{0}}, ' '), g -> g <> ''), g -> aggregate({chars('g')}, struct(0 AS d, 0 AS m), (a, x) -> struct(a.d + IF(x = '(', 1, -1) AS d, greatest(a.m, a.d + IF(x = '(', 1, -1)) AS m), a -> a.m))",
    "filter_by_substring": "filter({0}, x -> contains(x, {1}))",
    "sum_product": "struct(" + total("{0}") + " AS a, aggregate({0}, 1L, (a, x) -> a * x) AS b)",
    "rolling_max": "transform({0}, (x, i) -> array_max(slice({0}, 1, i + 1)))",
    "make_palindrome": let("n", f"array_min(filter({upto('length({0})', '0')}, i -> substr({{0}}, CAST(i AS INT) + 1) = reverse(substr({{0}}, CAST(i AS INT) + 1))))", "{0} || reverse(left({0}, CAST(n AS INT)))"),
    "string_xor": f"array_join(zip_with({chars('{0}')}, {chars('{1}')}, (a, b) -> IF(a = b, '0', '1')), '')",
    "longest": "aggregate({0}, CAST(NULL AS STRING), (a, x) -> IF(a IS NULL OR length(x) > length(a), x, a))",
    "greatest_common_divisor": f"aggregate({upto('64')}, struct(abs({{0}}) AS a, abs({{1}}) AS b), (s, i) -> IF(s.b = 0, s, struct(s.b AS a, s.a % s.b AS b)), s -> s.a)",
    "all_prefixes": f"transform({upto('length({0})')}, i -> left({{0}}, CAST(i AS INT)))",
    "string_sequence": f"array_join(transform({upto('{0}', '0')}, x -> CAST(x AS STRING)), ' ')",
    "count_distinct_characters": f"size(array_distinct({chars('lower({0})')}))",
    "parse_music": "transform(filter(split({0}, ' '), x -> x <> ''), x -> CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in NOTES.items()) + " END)",
    "how_many_times": f"CASE WHEN {{1}} = '' THEN length({{0}}) + 1 ELSE size(filter({upto('length({0})')}, i -> substr({{0}}, CAST(i AS INT), length({{1}})) = {{1}})) END",
    "sort_numbers": f"array_join(transform(array_sort(transform(filter(split({{0}}, ' '), x -> x <> ''), x -> array_position({_WORDS}, x))), p -> get({_WORDS}, CAST(p AS INT) - 1)), ' ')",
    "find_closest_elements": let("s", "array_sort({0})", f"array_min(transform({upto('size(s) - 1')}, i -> struct(get(s, CAST(i AS INT)) - get(s, CAST(i AS INT) - 1) AS d, get(s, CAST(i AS INT) - 1) AS a, get(s, CAST(i AS INT)) AS b)))"),
    "rescale_to_unit": "transform({0}, x -> (x - array_min({0})) / (array_max({0}) - array_min({0})))",
    "filter_integers": "transform(filter({0}, x -> x RLIKE '^[+-]?[0-9]+$'), x -> CAST(x AS BIGINT))",
    "strlen": "char_length({0})",
    "largest_divisor": f"array_max(filter({upto('{0} - 1')}, i -> {{0}} % i = 0))",
    "remove_duplicates": "filter({0}, x -> size(filter({0}, y -> y = x)) = 1)",
    "flip_case": f"translate({{0}}, '{LOWER}{UPPER}', '{UPPER}{LOWER}')",
    "concatenate": "array_join({0}, '')",
    "filter_by_prefix": "filter({0}, x -> startswith(x, {1}))",
    "get_positive": "filter({0}, x -> x > 0)",
    "is_prime": prime("{0}"),
    "sort_third": let("s", "array_sort(filter({0}, (x, i) -> i % 3 = 0))", "transform({0}, (x, i) -> IF(i % 3 = 0, get(s, CAST(i DIV 3 AS INT)), x))"),
    "unique": "array_sort(array_distinct({0}))",
    "max_element": "array_max({0})",
    "fizz_buzz": f"aggregate({upto('{0} - 1', '0')}, 0L, (a, i) -> a + IF(i % 11 = 0 OR i % 13 = 0, length(CAST(i AS STRING)) - length(replace(CAST(i AS STRING), '7', '')), 0))",
    "sort_even": let("s", "array_sort(filter({0}, (x, i) -> i % 2 = 0))", "transform({0}, (x, i) -> IF(i % 2 = 0, get(s, CAST(i DIV 2 AS INT)), x))"),
    "decode_cyclic": "regexp_replace({0}, '(?s)(.)(.)(.)', '$3$1$2')",
    "triples_sum_to_zero": f"exists({index('{0}')}, i -> exists({index('{0}')}, j -> exists({index('{0}')}, k -> i < j AND j < k AND get({{0}}, CAST(i AS INT)) + get({{0}}, CAST(j AS INT)) + get({{0}}, CAST(k AS INT)) = 0)))",
    "car_race_collision": "{0} * {0}",
    "incr_list": "transform({0}, x -> x + 1)",
    "pairs_sum_to_zero": "exists({0}, x -> x <> 0 AND array_contains({0}, -x)) OR size(filter({0}, x -> x = 0)) > 1",
    "change_base": "conv({0}, 10, {1})",
    "triangle_area": "{0} * {1} / 2D",
    "fib4": recurrence([0, 0, 2, 0], "p[0] + p[1] + p[2] + p[3]", "{0}"),
    "median": let("s", "array_sort({0})", "(get(s, CAST((size(s) - 1) DIV 2 AS INT)) + get(s, CAST(size(s) DIV 2 AS INT))) / 2D"),
    "is_palindrome": "{0} = reverse({0})",
    "modp": f"aggregate({upto('{0}')}, 1L % {{1}}, (a, i) -> a * 2 % {{1}})",
    "decode_shift": f"translate({{0}}, '{LOWER}', '{shifted(-5)}')",
    "remove_vowels": "regexp_replace({0}, '(?i)[aeiou]', '')",
    "below_threshold": "forall({0}, x -> x < {1})",
    "add": "{0} + {1}",
    "same_chars": f"array_sort(array_distinct({chars('{0}')})) = array_sort(array_distinct({chars('{1}')}))",
    "fib": recurrence([0, 1], "p[0] + p[1]", "{0}"),
    "correct_angles": BALANCE.replace("{o}", "<").replace("{e}", ">").replace("{c}", chars("{0}")),
    "monotonic": "{0} = sort_array({0}) OR {0} = sort_array({0}, false)",
    "common": "array_sort(array_intersect({0}, {1}))",
    "sum_to_n": "{0} * ({0} + 1) DIV 2",
    "correct_bracketing": BALANCE.replace("{o}", "(").replace("{e}", ")").replace("{c}", chars("{0}")),
    "derivative": "slice(transform({0}, (x, i) -> x * i), 2, size({0}))",
    "fibfib": recurrence([0, 0, 1], "p[0] + p[1] + p[2]", "{0}"),
    "vowels_count": "regexp_count({0}, '(?i)[aeiou]') + IF({0} RLIKE '(?i)y$', 1, 0)",
    "circular_shift": "IF({1} > length(CAST({0} AS STRING)), reverse(CAST({0} AS STRING)), right(CAST({0} AS STRING), {1}) || left(CAST({0} AS STRING), length(CAST({0} AS STRING)) - {1}))",
    "digit_sum_upper": f"aggregate(filter({chars('{0}')}, c -> c BETWEEN 'A' AND 'Z'), 0, (a, c) -> a + ascii(c))",
    "fruit_distribution": "{1} - " + total("transform(regexp_extract_all({0}, '[0-9]+', 0), x -> CAST(x AS BIGINT))"),
    "pluck": let("m", "array_min(transform(filter(transform({0}, (x, i) -> struct(x AS v, i AS i)), p -> p.v % 2 = 0), p -> p))", "IF(m IS NULL, CAST(array() AS ARRAY<BIGINT>), array(m.v, CAST(m.i AS BIGINT)))"),
    "search": "coalesce(array_max(filter({0}, x -> size(filter({0}, y -> y = x)) >= x)), -1)",
    "strange_sort_list": let("s", "array_sort({0})", "transform(s, (x, i) -> IF(i % 2 = 0, get(s, CAST(i DIV 2 AS INT)), get(s, CAST(size(s) - 1 - i DIV 2 AS INT))))"),
    "triangle_area_sides": let("p", "({0} + {1} + {2}) / 2D", "IF({0} + {1} <= {2} OR {0} + {2} <= {1} OR {1} + {2} <= {0}, -1D, round(sqrt(p * (p - {0}) * (p - {1}) * (p - {2})), 2))"),
    "will_it_fly": "{0} = reverse({0}) AND " + total("{0}") + " <= {1}",
    "smallest_change": "CAST(size(filter(zip_with({0}, reverse({0}), (a, b) -> a <> b), x -> x)) DIV 2 AS INT)",
    "total_match": "IF(length(array_join({0}, '')) <= length(array_join({1}, '')), {0}, {1})",
    "is_simple_power": f"exists({upto('63', '0')}, i -> pow(CAST({{1}} AS DOUBLE), i) = {{0}})",
    "iscube": let("r", "CAST(round(cbrt(abs({0}))) AS BIGINT)", "r * r * r = abs({0})"),
    "hex_key": "regexp_count({0}, '[2357BD]')",
    "decimal_to_binary": "concat('db', bin({0}), 'db')",
    "is_happy": f"length({{0}}) >= 3 AND forall({upto('length({0}) - 2')}, i -> size(array_distinct({chars('substr({0}, CAST(i AS INT), 3)')})) = 3)",
    "numerical_letter_grade": "transform({0}, g -> CASE " + " ".join(f"WHEN g {'=' if v == 4.0 else '>'} {v}D THEN '{n}'" for v, n in GRADES) + " ELSE 'E' END)",
    "prime_length": prime("length({0})"),
    "starts_one_ends": "IF({0} = 1, 1L, CAST(18 * pow(10, {0} - 2) AS BIGINT))",
    "digit_sum_binary": f"bin({digit_sum('{0}')})",
    "add_even_at_odd": "aggregate(filter({0}, (x, i) -> i % 2 = 1 AND x % 2 = 0), 0L, (a, x) -> a + x)",
    "anti_shuffle": f"array_join(transform(split({{0}}, ' '), w -> array_join(array_sort({chars('w')}), '')), ' ')",
    "get_row": "transform(array_sort(flatten(transform({0}, (row, i) -> transform(filter(transform(row, (x, j) -> struct(x AS v, j AS j)), p -> p.v = {1}), p -> struct(i AS r, -p.j AS c))))), q -> struct(q.r AS a, -q.c AS b))",
    "sort_by_ends_parity": "IF(size({0}) = 0, {0}, IF((get({0}, 0) + get({0}, size({0}) - 1)) % 2 = 0, sort_array({0}, false), sort_array({0})))",
    "encrypt": f"translate({{0}}, '{LOWER}', '{shifted(4)}')",
    "next_smallest": "get(array_sort(array_distinct({0})), 1)",
    "is_bored": "size(filter(split({0}, '[.?!]\\\\s*'), x -> startswith(x, 'I ')))",
    "any_int": "{0} = floor({0}) AND {1} = floor({1}) AND {2} = floor({2}) AND ({0} + {1} = {2} OR {0} + {2} = {1} OR {1} + {2} = {0})",
    "encode": f"translate(translate({{0}}, '{LOWER}{UPPER}', '{UPPER}{LOWER}'), 'aeiouAEIOU', 'cgkqwCGKQW')",
    "largest_prime_digits": let("m", f"array_max(filter({{0}}, x -> {prime('x')}))", digit_sum("m")),
    "check_dict_case": "size(map_keys({0})) > 0 AND (forall(map_keys({0}), k -> k = lower(k)) OR forall(map_keys({0}), k -> k = upper(k)))",
    "count_up_to": f"filter({upto('{0} - 1', '2')}, x -> {prime('x')})",
    "multiply_units": "abs({0} % 10) * abs({1} % 10)",
    "count_upper": f"size(filter({chars('{0}')}, (c, i) -> i % 2 = 0 AND c IN ('A', 'E', 'I', 'O', 'U')))",
    "closest_integer": "CAST(round(CAST({0} AS DOUBLE)) AS BIGINT)",
    "make_a_pile": f"transform({upto('{0} - 1', '0')}, i -> {{0}} + 2 * i)",
    "words_string": "filter(split({0}, '[,\\\\s]+'), x -> x <> '')",
    "choose_num": "CASE WHEN {0} > {1} THEN -1 WHEN {1} % 2 = 0 THEN {1} WHEN {0} = {1} THEN -1 ELSE {1} - 1 END",
    "rounded_avg": "IF({0} > {1}, '-1', '0b' || bin(CAST(bround(({0} + {1}) / 2D) AS BIGINT)))",
    "unique_digits": "array_sort(filter({0}, x -> NOT CAST(x AS STRING) RLIKE '[02468]'))",
    "by_length": f"transform(sort_array(filter({{0}}, x -> x BETWEEN 1 AND 9), false), x -> initcap(get({_WORDS}, CAST(x AS INT))))",
    "factorials_and_sums": f"transform({upto('{0}')}, i -> IF(i % 2 = 0, aggregate({upto('i')}, 1L, (a, k) -> a * k), i * (i + 1) DIV 2))",
    "even_odd_palindrome": let("p", f"filter({upto('{0}')}, i -> CAST(i AS STRING) = reverse(CAST(i AS STRING)))", "struct(size(filter(p, x -> x % 2 = 0)) AS a, size(filter(p, x -> x % 2 = 1)) AS b)"),
    "count_nums": f"size(filter({{0}}, x -> {signed_digit_sum('x')} > 0))",
    "move_one_ball": "size({0}) = 0 OR size(filter(transform({0}, (x, i) -> x > get({0}, CAST((i + 1) % size({0}) AS INT))), b -> b)) <= 1",
    "exchange": "IF(size(filter({0}, x -> x % 2 = 0)) + size(filter({1}, x -> x % 2 = 0)) >= size({0}), 'YES', 'NO')",
    "histogram": let("w", "filter(split({0}, ' '), x -> x <> '')", let("c", "transform(array_distinct(w), x -> struct(x AS k, size(filter(w, y -> y = x)) AS n))", "map_from_entries(filter(c, p -> p.n = array_max(transform(c, q -> q.n))))")),
    "reverse_delete": let("s", "translate({0}, {1}, '')", "struct(s AS a, s = reverse(s) AS b)"),
    "odd_count": "transform(transform({0}, s -> CAST(regexp_count(s, '[13579]') AS STRING)), n -> concat('the number of odd elements ', n, 'n the str', n, 'ng ', n, ' of the ', n, 'nput.'))",
    "min_sub_array_sum": "aggregate({0}, struct(CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS m), (a, x) -> struct(least(x, coalesce(a.e, 0L) + x) AS e, least(a.m, x, coalesce(a.e, 0L) + x) AS m), a -> a.m)",
    "max_fill": "aggregate({0}, 0L, (a, row) -> a + CAST(ceil(" + total("row") + " / CAST({1} AS DOUBLE)) AS BIGINT))",
    "sort_by_ones": "transform(array_sort(transform({0}, x -> struct(bit_count(abs(x)) AS n, x AS x))), p -> p.x)",
    "select_words": "filter(split({0}, ' '), w -> w <> '' AND regexp_count(w, '(?i)[b-df-hj-np-tv-z]') = {1})",
    "get_closest_vowel": "regexp_extract({0}, '(?i)^.*[^aeiou]([aeiou])(?=[^aeiou])', 1)",
    "match_parens": let("a", chars("{0}[0] || {0}[1]"), let("b", chars("{0}[1] || {0}[0]"), "IF(" + BALANCE.replace("{o}", "(").replace("{e}", ")").replace("{c}", "a") + " OR " + BALANCE.replace("{o}", "(").replace("{e}", ")").replace("{c}", "b") + ", 'Yes', 'No')")),
    "maximum": "array_sort(slice(sort_array({0}, false), 1, {1}))",
    "odd_at_even": "aggregate(filter({0}, (x, i) -> i % 2 = 0 AND x % 2 <> 0), 0L, (a, x) -> a + x)",
    "add_elements": "aggregate(filter(slice({0}, 1, {1}), x -> length(CAST(abs(x) AS STRING)) <= 2), 0L, (a, x) -> a + x)",
    "get_odd_collatz": f"array_sort(array_distinct(filter(aggregate({upto('1000')}, array(CAST({{0}} AS BIGINT)), (a, i) -> IF(element_at(a, -1) = 1, a, array_append(a, IF(element_at(a, -1) % 2 = 0, element_at(a, -1) DIV 2, 3 * element_at(a, -1) + 1)))), x -> x % 2 = 1)))",
    "valid_date": "{0} RLIKE '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$' AND CASE WHEN substr({0}, 1, 2) IN ('01', '03', '05', '07', '08', '10', '12') THEN substr({0}, 4, 2) BETWEEN '01' AND '31' WHEN substr({0}, 1, 2) IN ('04', '06', '09', '11') THEN substr({0}, 4, 2) BETWEEN '01' AND '30' ELSE substr({0}, 1, 2) = '02' AND substr({0}, 4, 2) BETWEEN '01' AND '29' END",
    "split_words": f"CASE WHEN contains({{0}}, ' ') THEN split({{0}}, ' ') WHEN contains({{0}}, ',') THEN split({{0}}, ',') ELSE array(CAST(size(filter({chars('{0}')}, c -> c BETWEEN 'a' AND 'z' AND ascii(c) % 2 = 0)) AS STRING)) END",
    "is_sorted": "{0} = sort_array({0}) AND forall({0}, x -> size(filter({0}, y -> y = x)) <= 2)",
    "intersection": let("d", "least({0}.b, {1}.b) - greatest({0}.a, {1}.a)", f"IF({prime('d')}, 'YES', 'NO')"),
    "prod_signs": "IF(size({0}) = 0, NULL, aggregate({0}, 0L, (a, x) -> a + abs(x)) * aggregate({0}, 1L, (a, x) -> a * CAST(sign(x) AS BIGINT)))",
    "tri": f"transform({upto('{0}', '0')}, i -> CASE WHEN i = 0 THEN 1D WHEN i = 1 THEN 3D WHEN i % 2 = 0 THEN 1D + i / 2D ELSE pow((i + 3) / 2D, 2) - 1 END)",
    "digits": let("o", f"filter({chars('CAST({0} AS STRING)')}, d -> d IN ('1', '3', '5', '7', '9'))", "IF(size(o) = 0, 0L, aggregate(o, 1L, (a, d) -> a * CAST(d AS BIGINT)))"),
    "is_nested": "{0} RLIKE '\\\\[.*\\\\[.*\\\\].*\\\\]'",
    "sum_squares_ceil": "aggregate({0}, 0L, (a, x) -> a + CAST(pow(ceil(x), 2) AS BIGINT))",
    "last_char_is_a_letter": "{0} RLIKE '(^| )[A-Za-z]$'",
    "can_arrange": f"coalesce(array_max(filter({upto('size({0}) - 1')}, i -> get({{0}}, CAST(i AS INT)) < get({{0}}, CAST(i AS INT) - 1))), -1L)",
    "largest_smallest_integers": "struct(array_max(filter({0}, x -> x < 0)) AS a, array_min(filter({0}, x -> x > 0)) AS b)",
    "compare_one": "CASE WHEN try_cast(replace({0}, ',', '.') AS DOUBLE) > try_cast(replace({1}, ',', '.') AS DOUBLE) THEN {0} WHEN try_cast(replace({0}, ',', '.') AS DOUBLE) < try_cast(replace({1}, ',', '.') AS DOUBLE) THEN {1} END",
    "is_equal_to_sum_even": "{0} % 2 = 0 AND {0} >= 8",
    "special_factorial": f"aggregate({upto('{0}')}, struct(1L AS f, 1L AS p), (a, i) -> struct(a.f * i AS f, a.p * a.f * i AS p), a -> a.p)",
    "fix_spaces": "replace(regexp_replace({0}, ' {{3,}}', '-'), ' ', '_')",
    "file_name_check": "IF({0} RLIKE '^[A-Za-z][^.]*\\\\.(txt|exe|dll)$' AND regexp_count({0}, '[0-9]') <= 3, 'Yes', 'No')",
    "sum_squares": "aggregate(transform({0}, (x, i) -> CASE WHEN i % 3 = 0 THEN x * x WHEN i % 4 = 0 THEN x * x * x ELSE x END), 0L, (a, x) -> a + x)",
    "words_in_sentence": f"array_join(filter(split({{0}}, ' '), w -> {prime('length(w)')}), ' ')",
    "simplify": "(CAST(split({0}, '/')[0] AS BIGINT) * CAST(split({1}, '/')[0] AS BIGINT)) % (CAST(split({0}, '/')[1] AS BIGINT) * CAST(split({1}, '/')[1] AS BIGINT)) = 0",
    "order_by_points": stable("{0}", signed_digit_sum),
    "special_filter": "size(filter({0}, x -> x > 10 AND CAST(left(CAST(x AS STRING), 1) AS INT) % 2 = 1 AND x % 2 = 1))",
    "get_max_triples": let("z", f"CAST(size(filter({upto('{0}')}, i -> (i * i - i + 1) % 3 = 0)) AS BIGINT)", "z * (z - 1) * (z - 2) DIV 6 + ({0} - z) * ({0} - z - 1) * ({0} - z - 2) DIV 6"),
    "planets_between": let("p", f"array_position({_PLANETS}, {{0}})", let("q", f"array_position({_PLANETS}, {{1}})", f"IF(p = 0 OR q = 0 OR p = q, CAST(array() AS ARRAY<STRING>), slice({_PLANETS}, CAST(least(p, q) + 1 AS INT), CAST(abs(p - q) - 1 AS INT)))")),
    "sorted_list_sum": "transform(array_sort(transform(filter({0}, s -> length(s) % 2 = 0), s -> struct(length(s) AS n, s AS s))), p -> p.s)",
    "x_or_y": f"IF({prime('{0}')}, {{1}}, {{2}})",
    "double_the_difference": "aggregate(filter({0}, x -> x > 0 AND x = floor(x) AND x % 2 = 1), 0L, (a, x) -> a + CAST(x * x AS BIGINT))",
    "compare": "zip_with({0}, {1}, (a, b) -> abs(a - b))",
    "strongest_extension": "concat({0}, '.', array_max(transform({1}, (e, i) -> struct(regexp_count(e, '[A-Z]') - regexp_count(e, '[a-z]') AS k, -i AS i, e AS e))).e)",
    "cycpattern_check": f"exists({upto('length({1}) - 1', '0')}, i -> contains({{0}}, substr({{1}}, CAST(i AS INT) + 1) || left({{1}}, CAST(i AS INT))))",
    "even_odd_count": "struct(regexp_count(CAST({0} AS STRING), '[02468]') AS a, regexp_count(CAST({0} AS STRING), '[13579]') AS b)",
    "int_to_mini_roman": "aggregate(array(" + ", ".join(f"struct({v} AS v, '{s}' AS s)" for v, s in ROMAN) + "), struct({0} AS n, '' AS r), (a, x) -> struct(a.n % x.v AS n, a.r || repeat(x.s, CAST(a.n DIV x.v AS INT)) AS r), a -> a.r)",
    "right_angle_triangle": "{0} * {0} + {1} * {1} = {2} * {2} OR {0} * {0} + {2} * {2} = {1} * {1} OR {1} * {1} + {2} * {2} = {0} * {0}",
    "find_max": f"array_min(transform({{0}}, w -> struct(-size(array_distinct({chars('w')})) AS k, w AS w))).w",
    "eat": "array({0} + least({1}, {2}), {2} - least({1}, {2}))",
    "solve_case": f"IF({{0}} RLIKE '[A-Za-z]', translate({{0}}, '{LOWER}{UPPER}', '{UPPER}{LOWER}'), reverse({{0}}))",
    "string_to_md5": "IF({0} = '', NULL, md5({0}))",
    "generate_integers": "filter(sequence(least({0}, {1}), greatest({0}, {1})), x -> x % 2 = 0 AND x < 10)",
    "odd_digit_tuple": "size(filter({0}, x -> x % 2 <> 0))",
}


def separate_paren_groups(s: str) -> list[str]:
    out, depth, held = [], 0, ""
    for ch in s:
        if ch in "()":
            held += ch
            depth += 1 if ch == "(" else -1
            if not depth:
                out.append(held)
                held = ""
    return out


def factorize(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] * (n > 1)


def largest_prime_factor(n: int) -> int:
    return max(factorize(n), default=n)


def is_multiply_prime(n: int) -> bool:
    return n > 1 and len(factorize(n)) == 3


def find_zero(xs: list[float]) -> float:
    """A root of a polynomial of odd degree, by bisection."""
    value = lambda x: sum(c * x**i for i, c in enumerate(xs))
    low, high = -1.0, 1.0
    while value(low) * value(high) > 0:
        if high > 1e100:
            raise ValueError("the polynomial has no change of sign")
        low, high = low * 2, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if value(low) * value(mid) > 0 else (low, mid)
    return low


def prime_fib(n: int) -> int:
    if n < 1:
        raise ValueError("the first is number 1")
    a, b = 1, 1
    while True:
        a, b = b, a + b
        if len(factorize(a)) == 1:
            n -= 1
            if not n:
                return a


def do_algebra(operators: list[str], operands: list[int]) -> int:
    """Operands joined by operators, with the usual precedence; powers bind to the right."""
    values, ops = list(operands), list(operators)
    at = [i for i, op in enumerate(ops) if op == "**"]
    for i in reversed(at):
        values[i : i + 2] = [values[i] ** values[i + 1]]
        del ops[i]
    for group in (("*", "//"), ("+", "-")):
        i = 0
        while i < len(ops):
            if ops[i] in group:
                a, b = values[i], values[i + 1]
                values[i : i + 2] = [{"*": lambda: a * b, "//": lambda: a // b, "+": lambda: a + b, "-": lambda: a - b}[ops[i]]()]
                del ops[i]
            else:
                i += 1
    return values[0]


def min_path(grid: list[list[int]], k: int) -> list[int]:
    """The least path of k cells: from 1 to its smallest neighbour and back."""
    n = len(grid)
    i, j = next((i, j) for i in range(n) for j in range(n) if grid[i][j] == 1)
    near = min(grid[a][b] for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < n and 0 <= b < n)
    return [1 if step % 2 == 0 else near for step in range(k)]


#: name -> (function, return type, whether it takes more than one argument)
UDFS = {
    "separate_paren_groups": (separate_paren_groups, "array<string>"),
    "factorize": (factorize, "array<bigint>"),
    "largest_prime_factor": (largest_prime_factor, "bigint"),
    "is_multiply_prime": (is_multiply_prime, "boolean"),
    "find_zero": (find_zero, "double"),
    "prime_fib": (prime_fib, "bigint"),
    "do_algebra": (do_algebra, "bigint"),
    "min_path": (min_path, "array<bigint>"),
}


def call(name: str, *args: Column | str) -> Column:
    """The named function of columns (by name) or of SQL expressions."""
    if name in UDFS:
        f, kind = UDFS[name]
        return F.udf(f, kind, useArrow=True)(*[F.expr(a) if isinstance(a, str) else a for a in args])
    return F.expr(SQL[name].format(*[f"({a})" for a in args]))
