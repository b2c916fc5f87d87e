"""The rule language: ordered rules over tags, compiled to Spark expressions.

A rule is ``predicate {actions} [type]``. Rules run in order; what a rule sets is seen by
later ones, and the first rule with a type ends the run unless it says ``continue``. Every
tag that the rules mention becomes a column. Rules that change nothing for later ones are
evaluated side by side in one projection, whose first match ends the run; a projection is
added only where a rule changes tags. Nothing leaves the JVM, and a table is classified in
one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

_TOKEN = re.compile(r"""\s*(?:(\#[^\n]*)|("[^"]*"|'[^']*')|(!=|>=|<=|!~|[=<>~&|!(){}\[\];,])|([^\s=<>~&|!(){}\[\];,"']+))""")
#: Where the language keeps its own tags, as in ``feature:label:1``; a parameter of all functions.
NAMESPACE = "feature"


class RuleError(ValueError):
    """A rule file that cannot be understood."""


class Tokens:
    def __init__(self, source: str):
        self.items: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise RuleError(f"cannot read {source[at : at + 20]!r}")
            at = m.end()
            comment, quoted, sign, word = m.groups()
            if comment:
                continue
            self.items.append(("text", quoted[1:-1]) if quoted else ("sign", sign) if sign else ("word", word))
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if kind == "end" or value is not None and (kind == "text" or got != value):
            raise RuleError(f"expected {value or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def at_sign(self, *values: str) -> bool:
        kind, got = self.peek()
        return kind == "sign" and got in values

    def at_word(self, *values: str) -> bool:
        kind, got = self.peek()
        return kind == "word" and got in values


@dataclass(frozen=True)
class Test:
    """A comparison; ``other`` tells that the right side is a tag."""

    op: str
    left: str
    right: str = ""
    other: bool = False


@dataclass(frozen=True)
class Both:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


_INVERSE = {"=": "!=", "!=": "=", "=*": "!=*", "!=*": "=*", "~": "!~", "!~": "~", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def parse_expression(tokens: Tokens):
    def either():
        left = all_of()
        if tokens.at_sign("|"):
            tokens.take()
            return Both("|", left, either())
        return left

    def all_of():
        left = single()
        if tokens.at_sign("&"):
            tokens.take()
            return Both("&", left, all_of())
        return left

    def single():
        if tokens.at_sign("!"):
            tokens.take()
            if not tokens.at_sign("("):
                raise RuleError("! needs brackets")
            return Not(single())
        if tokens.at_sign("("):
            tokens.take()
            inner = either()
            tokens.take(")")
            return inner
        left = tokens.take()
        if left == "$" and tokens.at_sign("{"):
            tokens.take()
            left = tokens.take()
            tokens.take("}")
        elif tokens.at_sign("("):
            tokens.take()
            tokens.take(")")
            left += "()"
        left = left.removeprefix("$")
        if not tokens.at_sign("=", "!=", "<", "<=", ">", ">=", "~", "!~"):
            raise RuleError(f"{left} stands alone")
        op = tokens.take()
        kind, right = tokens.peek()
        tokens.take()
        if kind == "sign":
            raise RuleError(f"{left}{op} has no value")
        if right == "*" and kind == "word" and op in ("=", "!="):
            return Test(op + "*", left)
        if kind == "word" and right == "$" and tokens.at_sign("{"):
            tokens.take()
            right = "$" + tokens.take()
            tokens.take("}")
        if kind == "word" and right.startswith("$"):
            if op in ("~", "!~"):
                raise RuleError("a pattern must be a literal")
            return Test(op, left, right[1:], True)
        return Test(op, left, right)

    return either()


def without_not(expression, negated: bool = False):
    """Negations moved to the comparisons. A negated numeric test also holds for a missing
    tag, but not for one that is no number."""
    if isinstance(expression, Not):
        return without_not(expression.inner, not negated)
    if isinstance(expression, Both):
        op = {"&": "|", "|": "&"}[expression.op] if negated else expression.op
        return Both(op, without_not(expression.left, negated), without_not(expression.right, negated))
    if not negated:
        return expression
    inverse = Test(_INVERSE[expression.op], expression.left, expression.right, expression.other)
    if expression.op in ("<", "<=", ">", ">="):
        return Both("|", inverse, Test("!=*", expression.left))
    return inverse


#: Functions of an element that need a tag, and so cannot hold for an element without tags.
_WITH_TAG = ("maxspeedkmh()", "maxspeedmph()")


def indexable(expression) -> bool:
    """Whether the predicate needs some tag to be there; one that could hold for an element without tags is rejected."""
    if isinstance(expression, Both):
        sides = indexable(expression.left), indexable(expression.right)
        return any(sides) if expression.op == "&" else all(sides)
    return expression.op not in ("!=", "!=*", "!~") and (not expression.left.endswith("()") or expression.left in _WITH_TAG)


@dataclass
class Action:
    name: str
    key: str = ""
    values: list[str] = field(default_factory=list)
    #: Of apply and apply_once: what is done to members, and the role they must have.
    inner: list[Action] = field(default_factory=list)
    role: str | None = None


@dataclass
class FeatureType:
    code: int
    min_res: int = 24
    max_res: int = 24
    road_class: int | None = None
    road_speed: int | None = None
    default_name: str | None = None
    goes_on: bool = False
    with_actions: bool = False
    kind: str = "line"


@dataclass
class Rule:
    expression: object
    actions: list[Action] = field(default_factory=list)
    types: list[FeatureType] = field(default_factory=list)
    #: The finalize rules of the file that the rule comes from.
    final: list[Rule] = field(default_factory=list)


#: Resolution of each level, unless levels are given. Fixed values.
LEVELS = {0: 24, 1: 22, 2: 20, 3: 18, 4: 16}
#: Vehicles of access tags. Fixed values.
VEHICLES = ("foot", "bicycle", "car", "delivery", "truck", "bus", "taxi", "emergency")
_CHANGES = ("set", "add", "delete", "deletealltags", "rename", "setaccess", "addaccess")
_VALUES_OF_ACCESS = ("yes", "no", "true", "false", "1", "0")


def parse_actions(tokens: Tokens, ended_by: str = "}") -> list[Action]:
    out = []
    tokens.take("{")
    while not tokens.at_sign("}"):
        if tokens.at_sign(";"):
            tokens.take()
            continue
        action = Action(tokens.take())
        if action.name in ("set", "add"):
            action.key = tokens.take()
            tokens.take("=")
        elif action.name == "delete":
            action.key = tokens.take()
        elif action.name == "rename":
            action.key = tokens.take()
            action.values.append(tokens.take())
        elif action.name in ("apply", "apply_once"):
            if tokens.at_word("role"):
                tokens.take()
                tokens.take("=")
                action.role = tokens.take()
            action.inner = parse_actions(tokens)
            out.append(action)
            continue
        elif action.name not in ("name", "addlabel", "setaccess", "addaccess", "deletealltags", "echo", "echotags") and action.name not in ACTIONS:
            raise RuleError(f"unknown action {action.name}")
        while not tokens.at_sign(";", "}"):
            if tokens.at_sign("|"):
                tokens.take()
                continue
            value = tokens.take()
            if value == "$" and tokens.at_sign("{", "("):
                begin = tokens.take()
                end, inner = {"{": "}", "(": ")"}[begin], ""
                while not tokens.at_sign(end):
                    inner += tokens.take()
                tokens.take(end)
                value = "$" + begin + inner + end
            action.values.append(value)
        if action.name in ("setaccess", "addaccess") and any("$" not in v and v not in _VALUES_OF_ACCESS for v in action.values):
            raise RuleError(f"{action.name} needs one of {', '.join(_VALUES_OF_ACCESS)}")
        out.append(action)
    tokens.take("}")
    return out


def valid_type(kind: str, code: int) -> bool:
    """Whether a type is in the range of its kind: point, line, polygon or relation."""
    if code >= 0x10000:
        return code & 0xFF <= 0x1F
    if kind == "line":
        return code <= 0x3F
    if kind == "polygon":
        return code <= 0x7F and code != 0x4A
    return kind != "point" or code >= 0x100 and code & 0xFF <= 0x1F


def levels_of(type_: FeatureType, levels: dict[int, int]) -> tuple[int, int]:
    """(min_level, max_level) of a type: the coarsest level is that of its least resolution."""
    fits = lambda res: [n for n, bits in sorted(levels.items(), reverse=True) if bits <= res]
    low, high = fits(type_.max_res), fits(type_.min_res)
    last = lambda found: found[-1] if found else 0
    return last(low), last(high)


def _range(words: str, levels: dict[int, int] | None) -> tuple[int, int]:
    try:
        values = [int(x) for x in words.split("-")]
        values = [levels[v] for v in values] if levels else values
    except (ValueError, KeyError):
        raise RuleError(f"{words} is no level or resolution") from None
    return (min(values), max(values)) if len(values) > 1 else (values[0], 24)


def parse_type(tokens: Tokens, kind: str = "line", levels: dict[int, int] = LEVELS, overlaid: frozenset[int] = frozenset()) -> FeatureType:
    tokens.take("[")
    try:
        code = int(word := tokens.take(), 0)
    except ValueError:
        raise RuleError(f"{word} is no type") from None
    if kind == "polygon" and 0x100 <= code < 0x10000 and not code & 0xFF:
        code >>= 8
    if not valid_type(kind, code) and code not in overlaid:
        raise RuleError(f"{code:#x} is no type of a {kind}")
    out = FeatureType(code, kind=kind)
    while not tokens.at_sign("]"):
        word = tokens.take()
        if tokens.at_sign("="):
            tokens.take()
        if word in ("resolution", "level"):
            out.min_res, out.max_res = _range(tokens.take(), levels if word == "level" else None)
        elif word in ("road_class", "road_speed"):
            value = int(tokens.take())
            if not 0 <= value <= {"road_class": 4, "road_speed": 7}[word]:
                raise RuleError(f"{word} {value} is out of range")
            setattr(out, word, value)
        elif word == "default_name":
            out.default_name = tokens.take()
        elif word == "continue":
            out.goes_on, out.with_actions = True, False
        elif word in ("propagate", "with_actions", "withactions"):
            out.with_actions = True
        elif word == "no_propagate":
            out.with_actions = False
        elif word not in ("oneway", "access", "copy"):
            raise RuleError(f"unknown word {word} in a type")
    tokens.take("]")
    return out


class Reader:
    """Reads a file and what it includes: one list of rules, one count and stack of ifs, one finalize section."""

    def __init__(self, load: Callable[[str, str | None], str], kind: str, levels: dict[int, int], overlaid: frozenset[int], namespace: str):
        self.load, self.kind, self.levels, self.overlaid, self.namespace = load, kind, levels, overlaid, namespace
        self.rules: list[Rule] = []
        self.final: list[Rule] = []
        self.in_final, self.ifs, self.count, self.depth = False, [], 0, 0

    def _add(self, rule: Rule) -> None:
        if not indexable(rule.expression):
            raise RuleError("a predicate must not hold for an element without tags")
        if self.in_final and rule.types:
            raise RuleError("a finalize rule has a type")
        (self.final if self.in_final else self.rules).append(rule)

    def read(self, source: str) -> None:
        tokens = Tokens(source)
        while tokens.peek()[0] != "end":
            if tokens.at_word("include") and (tokens.peek(1)[0] in ("text", "word")):
                self._include(tokens)
            elif tokens.at_sign("<"):
                for part in ("<", "finalize", ">"):
                    tokens.take(part)
                if self.in_final:
                    raise RuleError("there are two finalize sections")
                self.in_final = True
            elif tokens.at_word("if") and tokens.peek(1) == ("sign", "("):
                tokens.take()
                condition = without_not(parse_expression(tokens))
                tokens.take("then")
                self.count += 1
                # Files of other kinds have conditions of their own, also where their rules run as one list.
                key = f"{self.namespace}:if:{self.kind}:{self.count}"
                # The condition is held from here on, whatever the rules inside set.
                self._add(Rule(self._within(condition), [Action("set", key, ["true"])]))
                self.ifs.append(Test("=", key, "true"))
            elif tokens.at_word("else") and self.ifs:
                tokens.take()
                self.ifs[-1] = without_not(Not(self.ifs[-1]))
            elif tokens.at_word("end") and self.ifs:
                tokens.take()
                self.ifs.pop()
            else:
                self._rule(tokens)

    def _within(self, expression):
        for condition in reversed(self.ifs):
            # In an else part the predicate comes first, as the condition needs no tag.
            expression = condition if expression is None else Both("&", condition, expression)
        if expression is None:
            raise RuleError("an empty predicate")
        return expression

    def _rule(self, tokens: Tokens) -> None:
        expression = None
        if self.ifs and tokens.at_sign("(") and tokens.peek(1) == ("sign", ")"):
            tokens.take()
            tokens.take()
        else:
            expression = without_not(parse_expression(tokens))
        expression = self._within(expression)
        actions = parse_actions(tokens) if tokens.at_sign("{") else []
        types = []
        while tokens.at_sign("["):
            types.append(parse_type(tokens, self.kind, self.levels, self.overlaid))
        if not types and not actions:
            raise RuleError("a rule has neither actions nor a type")
        if len(types) > 1 and any(a.name in _CHANGES for a in actions):
            raise RuleError("a rule with several types changes tags")
        if self.kind != "relation" and any(a.name.startswith("apply") for a in actions):
            raise RuleError("only a relation has members to apply actions to")
        if not types:
            self._add(Rule(expression, actions))
        for n, t in enumerate(types):
            t.goes_on = t.goes_on or n + 1 < len(types)
            self._add(Rule(expression, [] if n else actions, [t]))

    def _include(self, tokens: Tokens) -> None:
        tokens.take()
        name, style = tokens.take(), None
        if tokens.at_word("from"):
            tokens.take()
            style = tokens.take()
        if tokens.at_sign(";"):
            tokens.take()
        self.depth += 1
        if self.depth > 50:
            raise RuleError(f"{name} includes itself")
        self.read(self.load(name, style))
        self.depth -= 1


def parse_rules(
    source: str, includes: dict[str, str] | Callable[[str, str | None], str] | None = None, kind: str = "line",
    levels: dict[int, int] = LEVELS, overlaid: frozenset[int] = frozenset(), namespace: str = NAMESPACE,
) -> tuple[list[Rule], list[Rule]]:
    """The rules and the finalize rules of a file.

    includes gives the text of a file by its name, or by its name and the style it is from.
    """

    def load(name: str, style: str | None) -> str:
        if callable(includes):
            return includes(name, style)
        if not includes or name not in includes:
            raise RuleError(f"no file {name} to include")
        return includes[name]

    reader = Reader(load, kind, levels, overlaid, namespace)
    reader.read(source)
    if reader.ifs:
        raise RuleError("an if has no end")
    for rule in reader.rules:
        rule.final = reader.final
    return reader.rules, reader.final


@dataclass(frozen=True)
class Variable:
    """``${key|filter:argument}`` of a template, or ``$(key)`` of the local element."""

    key: str
    filters: tuple[str, ...] = ()
    local: bool = False


def template(value: str) -> list[str | Variable]:
    """The literal parts and variables of a template; bars and brackets within quotes are plain."""
    out: list[str | Variable] = []
    plain, at = "", 0
    while at < len(value):
        if value[at] == "$" and at + 1 < len(value) and value[at + 1] in "{(":
            close, parts, quote, at = {"{": "}", "(": ")"}[value[at + 1]], [""], "", at + 2
            local = close == ")"
            while at < len(value) and (quote or value[at] != close):
                c = value[at]
                if quote or c in "\"'":
                    quote, c = ("", "") if c == quote else (quote or c, c if quote else "")
                    parts[-1] += c
                elif c == "|":
                    parts.append("")
                else:
                    parts[-1] += c
                at += 1
            if at == len(value):
                raise RuleError(f"{value} has an open bracket")
            out += ([plain] if plain else []) + [Variable(parts[0].strip(), tuple(parts[1:]), local)]
            plain = ""
        else:
            plain += value[at]
        at += 1
    return out + [plain] if plain or not out else out


def keys_of(rules: list[Rule], namespace: str = NAMESPACE) -> set[str]:
    """Every tag that the rules read or write, functions among them."""
    found: set[str] = set()

    def walk(e) -> None:
        if isinstance(e, Both):
            walk(e.left)
            walk(e.right)
        else:
            found.add(e.left)
            if e.other:
                found.add(e.right)

    def act(a: Action, of_members: bool) -> None:
        if not of_members:
            if a.key:
                found.add(a.key)
            if a.name == "rename":
                found.update(a.values)
            if a.name in ("setaccess", "addaccess"):
                found.update(f"{namespace}:{v}" for v in VEHICLES)
            if a.name in ("name", "addlabel"):
                found.update(f"{namespace}:label:{i}" for i in range(1, 5))
        if a.name != "rename":
            for v in a.values:
                for part in template(v):
                    if isinstance(part, Variable) and not (of_members and part.local):
                        found.add(part.key)
                        found.update(f.rpartition(":")[2] for f in part.filters if f.startswith(("not-equal:", "not-contained:")))
        for inner in a.inner:
            act(inner, True)

    for r in rules:
        walk(r.expression)
        for a in r.actions:
            act(a, False)
    return found


def _part(value: Column, arg: str) -> Column:
    sign = next((s for s in ":><" if s in arg), None)
    separator, _, n = arg.partition(sign) if sign else (arg, "", "1")
    try:
        n = int(n.split(sign)[0] if sign else n)
    except ValueError:
        raise RuleError(f"part has no number in {arg!r}") from None
    if not n:
        raise RuleError("part counts from 1 or -1")
    of = {":": text.part, "<": text.parts_before, ">": text.parts_after}[sign or ":"]
    return of(value, n, separator or ";")


def _converted(value: Column, arg: str, sign: str = "") -> Column:
    source, _, target = arg.partition("=>")
    if target not in text.UNITS:
        raise RuleError(f"unknown unit in {arg!r}")
    return F.concat(F.lit(sign), text.converted(value, source, target))


def _height(value: Column, arg: str) -> Column:
    if arg and arg.partition("=>")[2] not in ("ft", "feet"):
        raise RuleError("height gives feet")
    return _converted(value, arg or "m=>ft", "\x1f")


def _substituted(value: Column, arg: str) -> Column:
    if "~>" in arg:
        return text.substituted(value, *arg.split("~>", 1), pattern=True)
    return text.substituted(value, *arg.split("=>", 1))


def _not_contained(value: Column, arg: str, tag) -> Column:
    separator, _, key = arg.rpartition(":")
    return text.not_contained(value, tag(key), separator or ";")


#: Value filters by name: (value, argument, tag) -> value. More can be added.
FILTERS: dict[str, Callable] = {
    "def": lambda value, arg, tag: text.default(value, arg),
    "conv": lambda value, arg, tag: _converted(value, arg),
    "height": lambda value, arg, tag: _height(value, arg),
    "subst": lambda value, arg, tag: _substituted(value, arg),
    "substring": lambda value, arg, tag: text.substring(value, *[int(x) for x in arg.split(":")]),
    "part": lambda value, arg, tag: _part(value, arg),
    "prefix": lambda value, arg, tag: F.concat(F.lit(text.prefix_of(arg)), value),
    "highway-symbol": lambda value, arg, tag: text.highway_symbol(value, arg.split(":")[0], *[int(x) for x in arg.split(":")[1:3]]),
    "not-equal": lambda value, arg, tag: text.not_equal(value, tag(arg)),
    "not-contained": _not_contained,
    "country-ISO": lambda value, arg, tag: text.country_iso(value),
    "ascii": lambda value, arg, tag: text.to_ascii(value),
    "latin1": lambda value, arg, tag: text.to_latin1(value),
}
#: Further actions by name: (tags, action, value) -> tags that change, as {key: column}.
ACTIONS: dict[str, Callable] = {}


def filtered(value: Column, spec: str, tag) -> Column:
    """One value filter, ``name:argument``."""
    name, _, arg = spec.partition(":")
    if name not in FILTERS:
        raise RuleError(f"unknown filter {name}")
    try:
        return FILTERS[name](value, arg, tag)
    except (ValueError, IndexError) as e:
        raise RuleError(f"{spec}: {e}") from None


class State:
    """The columns of one run: one for each tag, and the number of the rule that ended it."""

    def __init__(self, df: DataFrame, tag_of, keys: set[str], namespace: str):
        self.columns = {k: f"tag_{i}" for i, k in enumerate(sorted(keys))}
        none = F.lit(None).cast("string")
        hidden = lambda k: k.startswith(f"{namespace}:if:") or k.startswith(f"{namespace}:label:")
        self.df = df.withColumns({c: none if hidden(k) else tag_of(k) for k, c in self.columns.items()} | {"hit": F.lit(None).cast("int")})

    def tag(self, key: str) -> Column:
        return F.col(self.columns[key])

    def tags(self) -> dict[str, Column]:
        return {k: F.col(c) for k, c in self.columns.items()}

    def change(self, new: dict[str, Column], fires: Column) -> None:
        changed = {self.columns[k]: F.when(fires, v).otherwise(F.col(self.columns[k])) for k, v in new.items()}
        if changed:
            self.df = self.df.withColumns(changed)


def compiled(expression, tag) -> Column:
    """A predicate as a column that is never null."""
    if isinstance(expression, Both):
        left, right = compiled(expression.left, tag), compiled(expression.right, tag)
        return left & right if expression.op == "&" else left | right
    a = tag(expression.left)
    b = tag(expression.right) if expression.other else F.lit(expression.right)
    if expression.op in ("=*", "!=*"):
        return a.isNotNull() if expression.op == "=*" else a.isNull()
    if expression.op in ("=", "!="):
        same = F.coalesce(a == b, F.lit(False))
        return same if expression.op == "=" else ~same
    if expression.op in ("~", "!~"):
        fits = F.coalesce(a.rlike(rf"\A(?:{expression.right})\z"), F.lit(False))
        return fits if expression.op == "~" else ~fits
    x, y = text.number(a), text.number(b)
    less = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[expression.op]
    return F.coalesce(less, F.lit(False))


def built(value: str, tag) -> Column:
    """A template's text; null if any of its variables is."""
    parts = []
    for part in template(value):
        column = F.lit(part) if isinstance(part, str) else tag(part.key)
        for f in part.filters if isinstance(part, Variable) else ():
            column = filtered(column, f, tag)
        parts.append(column)
    return F.concat(*parts)


def acted(actions: list[Action], tags: dict[str, Column], namespace: str = NAMESPACE) -> dict[str, Column]:
    """The tags after the actions."""
    tags = dict(tags)
    none = F.lit(None).cast("string")
    for a in actions:
        if a.name in ("echo", "echotags", "apply", "apply_once"):
            continue
        value = F.coalesce(*[built(v, tags.__getitem__) for v in a.values]) if a.values and a.name != "rename" else none
        if a.name == "set":
            tags[a.key] = F.coalesce(value, tags[a.key])
        elif a.name == "add":
            tags[a.key] = F.coalesce(tags[a.key], value)
        elif a.name == "delete":
            tags[a.key] = none
        elif a.name == "deletealltags":
            tags = {k: v if k.endswith("()") else none for k, v in tags.items()}
        elif a.name == "rename":
            tags[a.values[0]], tags[a.key] = F.coalesce(tags[a.key], tags[a.values[0]]), none
        elif a.name == "name":
            tags[f"{namespace}:label:1"] = F.coalesce(tags[f"{namespace}:label:1"], value)
        elif a.name == "addlabel":
            keys = [f"{namespace}:label:{i}" for i in range(1, 5)]
            # The first free label, unless one before it has the same text.
            free, new = value.isNotNull(), {}
            for k in keys:
                new[k] = F.when(free & tags[k].isNull(), value).otherwise(tags[k])
                free = free & tags[k].isNotNull() & (tags[k] != value)
            tags |= new
        elif a.name in ("setaccess", "addaccess"):
            for v in VEHICLES:
                key = f"{namespace}:{v}"
                tags[key] = F.coalesce(value, tags[key]) if a.name == "setaccess" else F.coalesce(tags[key], value)
        else:
            tags |= ACTIONS[a.name](tags, a, value)
    return tags


def _finalized(final: list[Rule], tags: dict[str, Column], namespace: str) -> dict[str, Column]:
    """The tags after finalize rules, which run on every emission."""
    for f in final:
        holds, new = compiled(f.expression, tags.__getitem__), acted(f.actions, tags, namespace)
        tags = {k: v if new[k] is v else F.when(holds, new[k]).otherwise(v) for k, v in tags.items()}
    return tags


def _emission(t: FeatureType, labels: list[Column]) -> Column:
    shown = [F.coalesce(labels[0], F.lit(t.default_name)), *labels[1:]]
    return F.struct(
        F.lit(t.code).alias("type"), F.array_compact(F.array(*shown)).alias("labels"), F.lit(t.min_res).alias("min_res"), F.lit(t.max_res).alias("max_res"),
        F.lit(t.road_class).cast("int").alias("road_class"), F.lit(t.road_speed).cast("int").alias("road_speed"), F.lit(t.kind).alias("kind"),
    )


def run_rules(
    df: DataFrame, rules: list[Rule], tag_of, options: dict[str, str] | None = None, functions: dict[str, Column] | None = None,
    namespace: str = NAMESPACE, with_tags: bool = False, marks: list[int] | None = None, applies: Callable | None = None,
) -> DataFrame:
    """Adds ``emitted``, an array of what the rules emit, to the rows of df.

    ``tag_of(key)`` gives a tag's column, null for a missing one; functions gives those of
    element functions, as ``length()``; options become tags ``<namespace>:option:<key>``. With
    tags, ``tags`` is added, a map of all tags the rules mention as they are at the end. For each
    rule number in marks, ``fires_<n>`` tells whether it fired. applies(action, tag) gives the steps
    of an apply; ``applied`` then lists those that fired, with the numbers of the rule and the action.
    """
    keys = keys_of(rules + [f for r in rules for f in r.final], namespace) | {f"{namespace}:label:{i}" for i in range(1, 5)}
    finals = f"{namespace}:execute_finalize_rules"
    keys |= {f"{namespace}:default_name"} if any(t.default_name for r in rules for t in r.types) else set()
    given = {f"{namespace}:option:{k}": F.lit(v) for k, v in (options or {}).items()} | (functions or {})
    if unknown := sorted(k for k in keys if k.endswith("()") and k not in given):
        raise RuleError(f"no function {', '.join(unknown)} here")
    state = State(df, lambda k: given[k] if k in given else tag_of(k), keys, namespace)
    labels = [f"{namespace}:label:{i}" for i in range(1, 5)]
    emitted: list[str] = []
    marked: list[str] = []
    applied: list[str] = []

    def changes(rule: Rule) -> bool:
        """Whether later rules may see what the rule does. One that ends the run leaves its row as it is; its actions come last."""
        lasting = not rule.types or rule.types[0].goes_on and rule.types[0].with_actions
        return lasting and any(not a.name.startswith("apply") for a in rule.actions)

    at = 0
    while at < len(rules):
        end = at
        while end + 1 < len(rules) and not changes(rules[end]):
            end += 1
        part = rules[at : end + 1]
        # The predicates of all these rules see the same tags.
        state.df = state.df.withColumns({f"holds_{at + i}": compiled(r.expression, state.tag) for i, r in enumerate(part)})
        open_, hit, outs = F.col("hit").isNull(), None, {}
        for i, r in enumerate(part):
            n = at + i
            fires = open_ & F.col(f"holds_{n}")
            if marks and n in marks:
                outs[f"fires_{n}"] = fires
                marked.append(f"fires_{n}")
            for k, a in enumerate(r.actions):
                if applies and a.name.startswith("apply"):
                    before = acted(r.actions[:k], state.tags(), namespace)
                    if steps := applies(a, before.__getitem__):
                        row = F.struct(F.lit(n).alias("rule"), F.lit(k).alias("nth"), F.array(*steps).alias("steps"))
                        outs[f"applied_{n}_{k}"] = F.when(fires, row)
                        applied.append(f"applied_{n}_{k}")
            if r.types and r.types[0].goes_on:
                tags = acted(r.actions, state.tags(), namespace)
                tags |= {f"{namespace}:default_name": F.lit(r.types[0].default_name)} if r.types[0].default_name else {}
                tags = _finalized(r.final, tags, namespace)
                outs[f"out_{n}"] = F.when(fires, _emission(r.types[0], [tags[k] for k in labels]))
                emitted.append(f"out_{n}")
            elif r.types:
                # One flat chain: Spark's search for common parts takes exponential time for nested ones.
                hit = F.when(F.col(f"holds_{n}"), F.lit(n)) if hit is None else hit.when(F.col(f"holds_{n}"), F.lit(n))
                open_ = open_ & ~F.col(f"holds_{n}")
        outs["fires"] = fires
        if hit is not None:
            outs["hit"] = F.coalesce("hit", hit)
        state.df = state.df.withColumns(outs)
        if changes(part[-1]):
            tags = state.tags()
            new = acted(part[-1].actions, tags, namespace)
            state.change({k: v for k, v in new.items() if v is not tags[k]}, F.col("fires"))
        state.df = state.df.drop("fires", *[f"holds_{at + i}" for i in range(len(part))])
        at = end + 1

    # A row whose run has ended keeps its tags as they were then: now the actions of the rule that ended it are
    # done for all such rules in one projection, and then the finalize rules run.
    tags, late = state.tags(), {}
    for n, r in enumerate(rules):
        if r.types and not r.types[0].goes_on and r.actions:
            for k, v in acted(r.actions, tags, namespace).items():
                if v is not tags[k]:
                    late[k] = late[k].when(F.col("hit") == n, v) if k in late else F.when(F.col("hit") == n, v)
    if late:
        state.df = state.df.withColumns({state.columns[k]: v.otherwise(tags[k]) for k, v in late.items()})
    if defaults := {n: r.types[0].default_name for n, r in enumerate(rules) if r.types and not r.types[0].goes_on and r.types[0].default_name}:
        name = F.lit(None).cast("string")
        for n, v in defaults.items():
            name = F.when(F.col("hit") == n, F.lit(v)).otherwise(name)
        state.change({f"{namespace}:default_name": name}, F.col("hit").isNotNull())
    sections: dict[int, list[int]] = {}
    for n, r in enumerate(rules):
        if r.final:
            sections.setdefault(id(r.final), []).append(n)
    for numbers in sections.values():
        ended = F.col("hit").between(numbers[0], numbers[-1]) if numbers[-1] - numbers[0] + 1 == len(numbers) else F.col("hit").isin(numbers)
        if finals in keys and numbers[-1] == len(rules) - 1:
            ended = F.coalesce(ended, F.lit(False)) | (F.col("hit").isNull() & F.coalesce(state.tag(finals) == "true", F.lit(False)))
        for f in rules[numbers[0]].final:
            state.df = state.df.withColumn("holds", ended & compiled(f.expression, state.tag))
            tags = state.tags()
            new = acted(f.actions, tags, namespace)
            state.change({k: v for k, v in new.items() if v is not tags[k]}, F.col("holds"))
    shown = [state.tag(k) for k in labels]
    last = None
    for n, r in enumerate(rules):
        if r.types and not r.types[0].goes_on:
            row = _emission(r.types[0], shown)
            last = F.when(F.col("hit") == n, row) if last is None else last.when(F.col("hit") == n, row)
    all_out = [F.col(c) for c in emitted] + ([last] if last is not None else [])
    empty = "array<struct<type:int,labels:array<string>,min_res:int,max_res:int,road_class:int,road_speed:int,kind:string>>"
    out = F.array_compact(F.array(*all_out)) if all_out else F.array().cast(empty)
    more = [F.col(c) for c in marked]
    if applies:
        more.append((F.array_compact(F.array(*applied)) if applied else F.array()).alias("applied"))
    if with_tags:
        kept = [k for k in sorted(keys) if not k.endswith("()") and not k.startswith(f"{namespace}:if:")]
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), state.tag(k).alias("value")) for k in kept])
        more.append(F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("tags_after"))
    return state.df.select(*df.columns, *more, out.alias("emitted"))


def classify(
    df: DataFrame, source: str | list[Rule], tag_of, includes=None, options: dict[str, str] | None = None, functions: dict[str, Column] | None = None,
    kind: str = "line", levels: dict[int, int] = LEVELS, namespace: str = NAMESPACE,
) -> DataFrame:
    """Runs a rule file over the rows of df and explodes what it emits.

    Adds ordinal (of the emission within the row), type, labels, min_res, max_res, road_class,
    road_speed and kind; rows that emit nothing are left out. Other arguments are those of
    ``parse_rules`` and ``run_rules``.
    """
    rules = parse_rules(source, includes, kind, levels, namespace=namespace)[0] if isinstance(source, str) else source
    out = run_rules(df, rules, tag_of, options, functions, namespace)
    # An outer explode: for an inner one the optimizer puts all rules into a filter below it once more.
    return out.select(*df.columns, F.posexplode_outer("emitted").alias("ordinal", "e")).where("ordinal is not null").select(*df.columns, "ordinal", "e.*")


def statistics(df: DataFrame, rules: list[Rule], tag_of, **options) -> DataFrame:
    """(rule, fired): how many rows each rule fired on, by its number from 0."""
    out = run_rules(df, rules, tag_of, marks=list(range(len(rules))), **options)
    counts = out.agg(*[F.count_if(f"fires_{n}").alias(f"n{n}") for n in range(len(rules))])
    return counts.select(F.posexplode(F.array(*[f"n{n}" for n in range(len(rules))])).alias("rule", "fired"))


def overlaid(features: DataFrame, table: dict[int, list[int]]) -> DataFrame:
    """Features whose type is in the table appear once for each type it gives instead."""
    if not table:
        return features
    types = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    own = F.coalesce(F.try_element_at(types, F.col("type")), F.array("type"))
    return features.withColumn("type", F.explode(own))


