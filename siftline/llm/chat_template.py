"""Chat formatting with a compiled, sandboxed template language.

A template is text with `{{ expression }}`, `{% for x in expression %}`, `{% if %}`/`{% elif %}`/`{% else %}`,
`{% set name = expression %}` and `{% generation %}` ... `{% endgeneration %}` around what a model shall learn. Expressions
have literals, names, `.field` and `['field']` of mappings, `==`, `!=`, `<`, `>`, `in`, `and`, `or`, `not`, `+`, `~` and the filters below; there
are no calls and no access to Python attributes. The source becomes a syntax tree, constant parts of which are folded, and
the tree becomes nested Python closures, once a task.

The `escape` filter makes control strings inside a text harmless and is reversible: a backslash is doubled, and one goes
behind the first character of each control string. So turns and texts can be read back from the output alone.

Edge cases: null roles and texts are empty; null conv_ids form one conversation; rows of a conversation go by turn (null first), then
role and text, so ties and repeated rows have one order; an empty table gives no rows; extra columns are ignored. A
conversation is one text by nature and is held whole by one task; no other group is.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import ship

CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: Reading it back: see `turns`.
DEFAULT = (
    "{% for message in messages %}<|turn|>{{ message.role | escape }}<|text|>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|end|>{{ '\\n' }}{% endfor %}"
)
TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)

LEXER = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
TOKEN = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[<>+~|.\[\]()]))", re.DOTALL)


@lru_cache(maxsize=64)
def _escaper(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join([r"\\", *map(re.escape, sorted(controls, key=len, reverse=True))]))


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    return _escaper(controls).sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


FILTERS: dict[str, Callable] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}


class TemplateError(ValueError):
    pass


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, x) -> None:
        text = x if isinstance(x, str) else "" if x is None else str(x)
        self.parts.append(text)
        self.length += len(text)


# Expressions are tuples: ("const", value), ("name", n), ("field", e, e), ("filter", e, name), ("not", e), (operator, e, e).
OPERATORS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}"}
LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "in"), ("+", "~"))


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m.lastindex and (m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 else None

    def take(self, wanted: str | None = None) -> tuple[int, str]:
        if self.at >= len(self.tokens) or wanted and self.peek() != wanted:
            raise TemplateError(f"expected {wanted or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        out = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def level(self, n: int):
        if n == len(LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.peek() in LEVELS[n]:
            left = (self.take()[1], left, self.level(n + 1))
        return left

    def unary(self):
        if self.peek() == "not":
            self.take()
            return ("not", self.unary())
        kind, value = self.take()
        if kind == 1:
            out = ("const", ast.literal_eval(value))
        elif kind == 2:
            out = ("const", int(value))
        elif kind == 3:
            out = ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        elif value == "(":
            out = self.level(0)
            self.take(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek() in (".", "[", "|"):
            mark = self.take()[1]
            if mark == "[":
                out = ("field", out, self.level(0))
                self.take("]")
            else:
                kind, value = self.take()
                if kind != 3:
                    raise TemplateError(f"expected a name after {mark}")
                out = ("field", out, ("const", value)) if mark == "." else ("filter", out, value)
        return out


def parse(source: str) -> list:
    """Syntax tree: ("text", s), ("put", e), ("for", name, e, body), ("if", [(e, body), ...]), ("set", name, e), ("generation", body)."""
    root: list = []
    stack: list[tuple[str, list, list]] = [("", root, [])]  # closing word, body, branches of an if
    at = 0
    for m in LEXER.finditer(source):
        body = stack[-1][1]
        if m.start() > at:
            body.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("put", Expression(m[1]).whole()))
        if m[2] is None:
            continue
        word, _, rest = m[2].strip("- \n\t").partition(" ")
        if word == "for":
            name, found, over = rest.partition(" in ")
            if not found or not name.strip().isidentifier():
                raise TemplateError(f"cannot read for {rest!r}")
            inner: list = []
            body.append(("for", name.strip(), Expression(over).whole(), inner))
            stack.append(("endfor", inner, []))
        elif word == "if":
            branches = [(Expression(rest).whole(), [])]
            body.append(("if", branches))
            stack.append(("endif", branches[0][1], branches))
        elif word in ("elif", "else") and stack[-1][0] == "endif":
            closing, _, branches = stack.pop()
            branches.append((Expression(rest).whole() if word == "elif" else ("const", True), []))
            stack.append((closing, branches[-1][1], branches))
        elif word == "set":
            name, found, value = rest.partition("=")
            if not found or not name.strip().isidentifier():
                raise TemplateError(f"cannot read set {rest!r}")
            body.append(("set", name.strip(), Expression(value).whole()))
        elif word == "generation":
            inner = []
            body.append(("generation", inner))
            stack.append(("endgeneration", inner, []))
        elif word == stack[-1][0] and word:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"missing {stack[-1][0]}")
    if at < len(source):
        root.append(("text", source[at:]))
    return root


class Template:
    """A compiled template: render(messages) gives the text and the spans to learn from."""

    def __init__(self, source: str, controls: tuple[str, ...] = CONTROLS):
        self.filters = FILTERS | {"escape": lambda x: escape("" if x is None else str(x), controls)}
        self.run = self.body(self.fold_body(parse(source)))

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self.run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    # Folding.

    def fold(self, e):
        kind = e[0]
        if kind in ("const", "name"):
            return e
        if kind == "filter":
            if e[2] not in self.filters:
                raise TemplateError(f"no filter {e[2]!r}")
            parts = (self.fold(e[1]),)
            out = ("filter", parts[0], e[2])
        else:
            parts = tuple(map(self.fold, e[1:]))
            out = (kind, *parts)
        return ("const", self.value(out)({})) if all(p[0] == "const" for p in parts) else out

    def fold_body(self, nodes: list) -> list:
        out: list = []
        for node in nodes:
            for folded in self.fold_node(node):
                if folded[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + folded[1])
                elif folded != ("text", ""):
                    out.append(folded)
        return out

    def fold_node(self, node) -> list:
        """What stands for the node: constants become text, and of an if the branch that is always taken, or none."""
        kind = node[0]
        if kind == "put":
            e = self.fold(node[1])
            return [("text", "" if e[1] is None else str(e[1])) if e[0] == "const" else ("put", e)]
        if kind == "for":
            return [("for", node[1], self.fold(node[2]), self.fold_body(node[3]))]
        if kind == "set":
            return [("set", node[1], self.fold(node[2]))]
        if kind == "generation":
            return [("generation", self.fold_body(node[1]))]
        if kind != "if":
            return [node]
        branches = []
        for test, body in node[1]:
            test = self.fold(test)
            if test[0] != "const" or test[1]:
                branches.append((test, self.fold_body(body)))
            if test[0] == "const" and test[1]:
                break
        if branches and branches[0][0][0] == "const":
            return branches[0][1]
        return [("if", branches)] if branches else []

    # Closures.

    def value(self, e) -> Callable[[dict], object]:
        kind = e[0]
        if kind == "const":
            x = e[1]
            return lambda env: x
        if kind == "name":
            name = e[1]
            return lambda env: env.get(name)
        if kind == "filter":
            inner, act = self.value(e[1]), self.filters[e[2]]
            return lambda env: act(inner(env))
        if kind == "not":
            inner = self.value(e[1])
            return lambda env: not inner(env)
        a, b = self.value(e[1]), self.value(e[2])
        if kind == "and":
            return lambda env: a(env) and b(env)
        if kind == "or":
            return lambda env: a(env) or b(env)
        if kind == "field":

            def of(env):
                whole, key = a(env), b(env)
                if isinstance(whole, dict):
                    return whole.get(key)
                if isinstance(whole, list) and isinstance(key, int):
                    return whole[key]
                raise TemplateError(f"no field {key!r}")

            return of
        act = OPERATORS[kind]
        return lambda env: act(a(env), b(env))

    def body(self, nodes: list) -> Callable[[dict, Output], None]:
        steps = [self.step(n) for n in nodes]

        def run(env, out):
            for step in steps:
                step(env, out)

        return run

    def step(self, node) -> Callable[[dict, Output], None]:
        kind = node[0]
        if kind == "text":
            text = node[1]
            return lambda env, out: out.add(text)
        if kind == "put":
            value = self.value(node[1])
            return lambda env, out: out.add(value(env))
        if kind == "set":
            name, value = node[1], self.value(node[2])
            return lambda env, out: env.__setitem__(name, value(env))
        if kind == "generation":
            inner = self.body(node[1])

            def generate(env, out):
                start = out.length
                inner(env, out)
                out.spans.append((start, out.length))

            return generate
        if kind == "for":
            name, over, inner = node[1], self.value(node[2]), self.body(node[3])

            def loop(env, out):
                items = list(over(env) or [])
                for i, x in enumerate(items):
                    inner(env | {name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}}, out)

            return loop
        branches = [(self.value(test), self.body(body)) for test, body in node[1]]

        def choose(env, out):
            for test, body in branches:
                if test(env):
                    return body(env, out)

        return choose


def turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the default template's output."""
    found = list(TURN.finditer(formatted))
    if sum(len(m[0]) for m in found) != len(formatted):
        raise ValueError("not the default template's output")
    return [(unescape(m[1]), unescape(m[2])) for m in found]


FORMATTED = "conv_id long, formatted string, spans array<struct<start:long,stop:long>>"


def formatted(conversations: DataFrame, source: str = DEFAULT, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """conv_id, formatted, spans (code points to learn from) of each conversation in rows (conv_id, turn, role, text)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def whole(batches) -> Iterator[tuple]:
        """Conversations in the order of the rows, across batches."""
        now, messages = None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if messages and conv != now:
                    yield now, messages
                    messages = []
                now = conv
                messages.append({"role": role, "text": text})
        if messages:
            yield now, messages

    def run(batches):
        template = Template(source, controls)
        done: list[tuple] = []
        size = 0
        for conv, messages in whole(batches):
            text, spans = template.render(messages)
            done.append((conv, text, [{"start": a, "stop": b} for a, b in spans]))
            size += len(text)
            if size > 4 << 20:
                yield batch_of(done)
                done, size = [], 0
        if done:
            yield batch_of(done)

    def batch_of(done):
        kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], ["conv_id", "formatted", "spans"])

    return rows.mapInArrow(run, FORMATTED)


def read_back(done: DataFrame) -> DataFrame:
    """conv_id, n_turns and digests, from the formatted texts and their spans alone."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
                said = turns(text)
                learnt = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in said).encode()).hexdigest()
                out.append((conv, len(said), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return done.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(rows.unionByName(more)))


ORACLE_OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + length(regexp_replace(text, '(<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1.', 'g')) - length(text)
    + length(role) + 24 AS size FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
