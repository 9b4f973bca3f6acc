"""Text, path and name functions as columns. All are null-safe the way their docstrings say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Package words before a class name that are no part of it.
TARGET_PREFIX = r"^(?:main(?:\.java)?|java)\."
MANIFEST_PREFIX = r"^(?:main\.java|main|test\.java|test|java)\."
#: Spellings of Windows' long-path prefixes, longest first, with what stands for them.
LONG_PATHS = [("\\\\?\\UNC\\", "\\\\"), ("\\\\?\\", ""), ("//?/UNC/", "//"), ("//?/", ""), ("\\\\?/", ""), ("//?\\", "")]


#: The names that renumbering takes, of one digit, in the signature of a generated test.
NUMBERED_TEST = r"(?<=public void )test[0-9](?=\(\) throws Throwable \{)"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c(x), r"^\s+|\s+$", "")


def null_to_empty(x) -> Column:
    return F.coalesce(c(x), F.lit(""))


def one_line(x) -> Column:
    """White space collapsed to single blanks, ends trimmed; null is empty."""
    return strip(F.regexp_replace(null_to_empty(x), r"\s+", " "))


def blank_to_null(x) -> Column:
    return F.nullif(strip(c(x)), F.lit(""))


def require_non_blank(x, name: str) -> Column:
    """The value, or an error that names it."""
    return F.when(blank_to_null(x).isNull(), F.raise_error(F.lit(f"{name} must not be blank"))).otherwise(c(x))


def first_non_blank(*xs) -> Column:
    return F.coalesce(*[blank_to_null(x) for x in xs], F.lit(""))


def target_class_name(x) -> Column:
    """One leading main., main.java. or java. stripped."""
    return F.regexp_replace(c(x), TARGET_PREFIX, "")


def manifest_class_name(x) -> Column:
    """As target_class_name, with test. and test.java. too; javax. stays."""
    return F.regexp_replace(c(x), MANIFEST_PREFIX, "")


def safe_identifier(x) -> Column:
    """Runs of other characters become _; a blank is Mutant; a first character that no name may begin with gets M_."""
    clean = F.regexp_replace(strip(null_to_empty(x)), r"[^A-Za-z0-9_$]+", "_")
    return F.when(strip(null_to_empty(x)) == "", F.lit("Mutant")).when(clean.rlike("^[0-9]"), F.concat(F.lit("M_"), clean)).otherwise(clean)


def simple_name(x) -> Column:
    return F.substring_index(c(x), ".", -1)


def package_name(x) -> Column:
    return F.regexp_extract(c(x), r"^(.*)\.[^.]*$", 1)


def generated_test_name(class_name, mutant) -> Column:
    package = package_name(class_name)
    name = F.concat_ws("_", simple_name(class_name), safe_identifier(mutant), F.lit("Test"))
    return F.when(package == "", name).otherwise(F.concat_ws(".", package, name))


def java_file(root, class_name) -> Column:
    return F.concat(c(root), F.lit("/"), F.replace(c(class_name), F.lit("."), F.lit("/")), F.lit(".java"))


def normal_path(x) -> Column:
    """A path without . and .. segments and repeated slashes: segments are folded over a stack."""
    parts = F.filter(F.split(F.replace(c(x), F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    push = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    stack = F.aggregate(parts, F.array().cast("array<string>"), push)
    return F.concat(F.when(F.startswith(c(x), F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(stack, "/"))


def path_or_empty(x, root: str = "/") -> Column:
    """Blank stays empty; a relative path is placed under root."""
    absolute = F.when(F.startswith(c(x), F.lit("/")), c(x)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c(x)))
    return F.when(strip(null_to_empty(x)) == "", F.lit("")).otherwise(normal_path(absolute))


def strip_long_path(x) -> Column:
    raw = strip(c(x))
    out = raw
    for prefix, instead in LONG_PATHS[::-1]:
        out = F.when(F.startswith(raw, F.lit(prefix)), F.concat(F.lit(instead), F.substr(raw, F.lit(len(prefix) + 1)))).otherwise(out)
    return out


def path_for_json(x) -> Column:
    return F.replace(null_to_empty(strip_long_path(x)), F.lit("\\"), F.lit("/"))


def signature_of(source) -> Column:
    """What stands before the first brace."""
    return strip(F.substring_index(c(source), "{", 1))


def indented(x, levels: int = 1) -> Column:
    return F.regexp_replace(c(x), r"(?m)^", " " * (4 * levels))


def code_and_test(x) -> Column:
    """(code, test) around the line that begins the test function; test is null without one."""
    parts = F.split(c(x), r"def test\(\):", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("code"), F.get(parts, F.lit(1)).alias("test"))


def without_last_def(x) -> Column:
    """The text without its last def block; a text of one block keeps what stands before it."""
    parts = F.split(c(x), "def ")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "def ")


def import_block(x) -> Column:
    """The leading lines before the first def."""
    return strip(F.substring_index(c(x), "def ", 1))


def filled(template, marker: str, code) -> Column:
    return F.replace(c(template), F.lit(marker), c(code))


def sections(named: dict[str, Column], none: str = "<none>") -> Column:
    """Titled sections of string arrays, none where an array has no items."""
    parts = [F.concat(F.lit(f"{title}:\n"), F.when(F.size(F.coalesce(items, F.array())) == 0, F.lit(none)).otherwise(F.array_join(items, "\n"))) for title, items in named.items()]
    return F.concat_ws("\n\n", *parts)


def prompt_initial(code, template: str = "# Write tests for the code below.\n{code}\n") -> Column:
    return filled(F.lit(template), "{code}", code)


def prompt_repair(code, error, template: str = "# The test below fails to parse: {error}\n{code}\n# Fixed test:\n") -> Column:
    return filled(filled(F.lit(template), "{code}", code), "{error}", error)


def prompt_augment(code, test, mutant, template: str = "{code}\n{test}\n# The test misses this fault:\n{mutant}\n# A test that finds it:\n") -> Column:
    return filled(filled(filled(F.lit(template), "{code}", code), "{test}", test), "{mutant}", mutant)


def without_package(name, package) -> Column:
    """The name after its package and dot."""
    return F.substr(c(name), F.length(c(package)) + 2)


def range_text(kind, on_source, start, end, description) -> Column:
    return F.format_string("[%s]%s %d-%d : %s", F.when(c(on_source), "src").otherwise("dst"), c(kind), c(start), c(end), c(description))


def fenced_code(x, language: str = "java") -> Column:
    """The first fenced block's body, or the text if it has none."""
    body = F.regexp_extract(c(x), rf"(?s)```(?:{language})?[ \t]*\n(.*?)```", 1)
    return F.when(body == "", c(x)).otherwise(body)


def imports_of(x) -> Column:
    return F.array_join(F.regexp_extract_all(c(x), F.lit(r"(?m)^\s*(import\s+[^;]+;)"), F.lit(1)), "\n")


def test_method(x) -> Column:
    """The method text of an answer: code of the fence without imports, from @Test on; @Test is added where missing."""
    code = strip(F.regexp_replace(fenced_code(x), r"(?m)^\s*import\s+[^;]+;\s*$", ""))
    return F.when(code.contains("@Test"), F.substr(code, F.instr(code, "@Test"))).otherwise(F.concat(F.lit("@Test\n"), code))


def renamed_class(source, name: str) -> Column:
    return F.regexp_replace(c(source), r"(?<=\bclass\s)\w+", name)


def complete(text, finish_reason) -> Column:
    """The text, or an error if the answer was cut by its length."""
    return F.when(c(finish_reason) == "length", F.raise_error(F.lit("model output is truncated"))).otherwise(c(text))


def hashed_file_name(x, suffix: str = "") -> Column:
    return F.concat(F.sha2(c(x), 256), F.lit(suffix))


def change_parts(x) -> Column:
    """(before, after) of "a => b" or "a --> b", trimmed."""
    parts = F.split(c(x), r"\s*(?:=>|-->)\s*", 2)
    return F.struct(strip(F.get(parts, F.lit(0))).alias("before"), strip(F.get(parts, F.lit(1))).alias("after"))


def option_name(x) -> Column:
    """An option without its leading dashes or other marks."""
    return F.regexp_replace(c(x), r"^[^\p{L}\p{Nd}]+", "")


def suite_class(sources, fallback: str) -> Column:
    """The class that is a suite already, else a made one; sources are an array of class names."""
    suites = F.filter(c(sources), lambda s: s.rlike(r"(?:RegressionTest|Suite)$"))
    return F.when(F.size(suites) > 0, F.get(suites, F.lit(0))).otherwise(F.lit(fallback))


def timing_line(timing: Column) -> Column:
    """One log line of a timing struct: name=value pairs in the struct's order."""
    return F.regexp_replace(F.regexp_replace(F.to_json(timing), r'[{}"]', ""), ":", "=")


def renumbered_tests(x) -> Column:
    """Test methods of one-digit names numbered from 0 in the order of the text; the rest of the text stays."""
    parts = F.split(c(x), NUMBERED_TEST)
    return F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit("test"), (i - 1).cast("string"), part))), "")
