"""A heuristic parser of Java sources: one pass over each file, emitting rows tagged by kind.

It reads declarations by pattern and braces, not by a full grammar: types are resolved through imports and the own
package only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.workers import importable, spread

SCHEMA = "kind string, id string, owner string, name string, value string, extra array<string>, number int, path string"
#: Each pattern begins with a look at what any match of it has to begin with, so that most places are passed at once.
_CLASS = re.compile(r"(?=[@pafscie])((?:@[\w.]+(?:\([^)]*\))?\s*)*)((?:(?:public|protected|private|abstract|final|static)\s+)*)(class|interface|enum)\s+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([\w.]+)(?:<[^{]*?>)?)?(?:\s+(?:implements|extends)\s+([\w.,<>\s]+?))?\s*\{")
_METHOD = re.compile(r"(?=@|[\w.<>\[\], ?\s]*+(?<=[\w\s])\(|[\w\s]*<)((?:@[\w.]+(?:\((?:[^()]|\([^)]*\))*\))?\s*)*)((?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*)(?:<[^>]+>\s+)?([\w.<>\[\], ?]+?\s+)?(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w.,\s]+)?(\{|;)")
_FIELD = re.compile(r"(?=[@psftv])((?:@[\w.]+(?:\([^)]*\))?\s*)*)((?:(?:private|protected|public|static|final|transient|volatile)\s+)+)([\w.]+(?:<[^;=]*>)?(?:\[\])?)\s+(\w+)\s*(?:=[^;]*)?;")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "new", "else", "throw", "try", "synchronized", "super", "this", "do", "assert"}
#: What adds a path through a method; && and || don't.
_BRANCH = re.compile(r"(?=[iwfcd?])(?:\b(?:if|while|for|catch)\b\s*\(|\bdo\b\s*\{|\bcase\b[^:]*:|(?<![<,])\?(?![>,\s]*[>,])[^:;]*:)")
_WRITES = ("persist", "merge", "remove", "save", "saveAll", "saveAndFlush", "delete", "deleteAll", "deleteById", "executeUpdate", "flush")
_WRITING = re.compile(rf"\.\s*(?:{'|'.join(_WRITES)})\s*\(")
_SKIPPED = ("java.lang", "java.util", "java.io", "java.nio")
#: Types that need no import.
_LANG = frozenset("Boolean Byte Character Class Double Enum Error Exception Float Integer Iterable Long Number Object Runnable Short String StringBuilder Thread Throwable Void".split())


def blank(source: str) -> str:
    """Comments and literals replaced by spaces of equal length, so positions stay."""
    return re.sub(r'/\*.*?\*/|//[^\n]*|"""(?:.*?)"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def closing(code: str, at: int) -> int:
    """Position behind the brace that closes the one at `at`; the end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def parse(path: str, source: str) -> list[tuple]:
    """Rows of one file; a file without a class gives none."""
    code = blank(source)
    package = m[1] if (m := re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M)) else ""
    imports = re.findall(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", code, re.M)
    by_name = {i.rsplit(".", 1)[-1]: i for i in imports}

    def full(name: str) -> str:
        name = re.sub(r"<.*", "", name, flags=re.S).strip().removesuffix("[]")
        if "." in name or name in by_name:
            return by_name.get(name, name)
        return f"java.lang.{name}" if name in _LANG else f"{package}.{name}" if package and name[:1].isupper() else name

    notes = lambda text: [full(a) for a in re.findall(r"@([\w.]+)", text)]
    rows: list[tuple] = []
    spans = []
    for c in _CLASS.finditer(code):
        spans.append((c.start(), closing(code, c.end() - 1), c))
    names: dict[int, str] = {}
    for begin, end, c in spans:
        outer = [b for b, e, _ in spans if b < begin and end <= e]
        fqn = f"{names[outer[-1]]}.{c[4]}" if outer else f"{package}.{c[4]}" if package else c[4]
        names[begin] = fqn
        annotations = notes(c[1] or "")
        simple = {a.rsplit(".", 1)[-1] for a in annotations}
        interfaces = [full(x) for x in re.sub(r"<[^<>]*>", "", c[6] or "").split(",") if x.strip()]
        labels = []
        if "Service" in simple:
            labels.append("Service")
        if "Repository" in simple or any(x.endswith("Repository") for x in interfaces):
            labels.append("Repository")
        parent = full(c[5]) if c[5] else ""
        legacy = [i for i in imports if i.startswith("com.vaadin.") and not i.startswith("com.vaadin.flow.")]
        if any(x.endswith(("View", ".UI", "Panel")) and (x in legacy or x.startswith("com.vaadin.")) for x in [parent, *interfaces]):
            labels.append("VaadinView")
        elif parent in legacy:
            labels.append("VaadinComponent")
        body = code[c.end() : end]
        inner = [(b - c.end(), e - c.end()) for b, e, _ in spans if begin < b and e <= end]
        own = list(body)
        for b, e in inner:
            own[b:e] = " " * (e - b)
        body = "".join(own)
        if re.search(r"\b(?:BeanFieldGroup|FieldGroup|BeanItemContainer)\b", body):
            labels.append("VaadinDataBinding")
            rows += [("binds", fqn, fqn, full(x), "", [], None, path) for x in sorted(set(re.findall(r"\b(?:BeanFieldGroup|FieldGroup|BeanItemContainer)\s*<\s*(\w+)", body)))]
        rows.append(("class", fqn, package, c[4], parent, [c[3], *labels], None, path))
        rows += [("annotation", fqn, fqn, a, "", [], None, path) for a in annotations]
        rows += [("implements", fqn, fqn, x, "", [], None, path) for x in interfaces]
        if "Entity" in simple:
            table = re.search(r"@Table\s*\(\s*(?:[^)]*?name\s*=\s*)?\"([^\"]+)\"", source[max(0, c.start() - 300) : c.end()])
            rows.append(("table", fqn, fqn, (table[1] if table else snake(c[4])).lower(), "", [], None, path))
        if c[3] == "enum":
            head = body.split(";", 1)[0]
            rows += [("constant", fqn, fqn, x, "", [], None, path) for x in re.findall(r"(?:^|,)\s*([A-Z][A-Z0-9_]*)\b", head)]
        methods, covered = [], []
        for m in _METHOD.finditer(body):
            if m[4] in _NOT_METHODS or (m[3] is None and m[4] != c[4]) or (m[3] or "").split(" ")[0] in ("return", "new", "throw", "else") or any(b <= m.start() < e for b, e in covered):
                continue
            stop = closing(body, m.end() - 1) if m[6] == "{" else m.end()
            covered.append((m.start(), stop))
            made = m[4] == c[4]  # a constructor has no type before its name
            kinds = [re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", "", p).strip().rsplit(" ", 1)[0] for p in re.split(r",(?![^<]*>)", m[5]) if p.strip()]
            method = f"{fqn}#{m[4]}({','.join(kinds)})"
            text = body[m.end() : stop]
            ways = 1 + len(_BRANCH.findall(text))
            raw = source[c.end() + m.start() : c.end() + stop]
            writes = int(bool(re.search(r"@Modifying\b", m[1] or ""))) or int(bool(re.search(r"@Query\s*\([^)]*\"\s*(?:update|delete|insert)", raw, re.I)))
            writes += int(bool(_WRITING.search(text)))
            methods.append(m[4])
            rows.append(("method", method, fqn, m[4], re.sub(r"^(?:(?:public|protected|private|static|final|abstract|synchronized|default)\b\s*)+", "", (m[3] or "").strip()), [str(writes), "constructor" if made else "method"], ways, path))
            rows += [("call", method, fqn, x, "", [], None, path) for x in sorted(set(re.findall(r"(?<![\w@])(\w+)\s*\(", text)) - _NOT_METHODS) if not x[:1].isupper()]
            rows += [("text_key", method, fqn, x, "", [], None, path) for x in re.findall(r"getNLS\s*\(\s*\"([^\"]+)\"", raw)]
            if "Repository" in labels and ("@Query" in (m[1] or "") or re.match(r"(?:find|get|read|query|count|exists|delete)\w*By", m[4])):
                rows.append(("query_method", method, fqn, m[4], "", [], None, path))
            if made:
                rows += [("depends", fqn, fqn, full(k), "CONSTRUCTOR", [], None, path) for k in kinds if full(k) in imports or "." in full(k)]
        rest = list(body)
        for b, e in covered:
            rest[b:e] = " " * (e - b)
        for f in _FIELD.finditer("".join(rest)):
            kind = full(f[3])
            rows.append(("field", f"{fqn}#{f[4]}", fqn, f[4], f[3], notes(f[1] or ""), None, path))
            if any(a.rsplit(".", 1)[-1] in ("Autowired", "Inject", "Resource") for a in notes(f[1] or "")) or "final" in f[2] and "static" not in f[2]:
                if not kind.startswith(_SKIPPED) and "." in kind:
                    rows.append(("depends", fqn, fqn, kind, "FIELD", [f[4]], None, path))
    if spans:
        rows += [("import", names[spans[0][0]], names[spans[0][0]], i, "", [], None, path) for i in imports]
    return rows


def method_body(source: str, name: str) -> str:
    """The text of the first `name(...) {...}`; empty if there is none."""
    code = blank(source)
    m = re.search(rf"[^\n;{{}}]*\b{re.escape(name)}\s*\([^()]*(?:\([^()]*\)[^()]*)*\)[^;{{]*\{{", code)
    return source[m.start() : closing(code, m.end() - 1)].strip() if m else ""


def header_text(simple_name: str, package: str, source: str) -> str:
    """What a class's header chunk says: its name and package, the last Javadoc before its declaration, its fields.

    Fields are the lines with a semicolon between the class's brace and the first line that looks like a method; a text
    without a declaration gives the first line only.
    """
    lines = [f"[CLASS: {simple_name}] [PACKAGE: {package}]"]
    at = next((i for i in map(source.find, (" class ", " interface ", " enum ")) if i >= 0), -1)
    if at >= 0:
        end = source.rfind("*/", 0, at)
        begin = source.rfind("/**", 0, max(end, 0))
        if 0 <= begin < end:
            lines.append(source[begin : end + 2].strip())
        brace = source.find("{", at)
        body = [] if brace < 0 else source[brace + 1 :].split("\n")
        is_method = lambda x: "(" in x and ")" in x and "=" not in x and not x.strip().startswith(("//", "*"))
        body = body[: next((i for i, x in enumerate(body) if is_method(x)), len(body))]
        fields = [x for x in body if ";" in x and not x.strip().startswith("//") and not re.search("class |enum |interface ", x)]
        if any(x.strip() for x in fields):
            lines.append("\n".join(fields).strip())
    return "\n".join(lines).strip()


def method_text(simple_name: str, signature: str, source: str) -> str:
    """What a method's chunk says: class, signature and the braces behind the first place where its name is called or made."""
    name = signature.partition("(")[0]
    at = source.find(f"{name}(")
    brace = source.find("{", at) if at >= 0 else -1
    body = "[source not found]"
    if brace >= 0:
        depth, end = 0, brace
        for m in re.compile("[{}]").finditer(source, brace):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                end = m.end()
                break
        body = source[brace:end].strip()
    return f"[CLASS: {simple_name}] [METHOD: {signature}]\n{body}".strip()


def chunk_texts(classes: DataFrame, methods: DataFrame, sources: DataFrame) -> DataFrame:
    """classes(fqn, simple_name, package_name, source_path), methods(fqn, method_id), sources(path, content) -> (fqn,
    method_id, text): the header's text, where method_id is null, and one for each method, of classes whose source is there."""
    named = classes.where("source_path is not null").select("fqn", "simple_name", "package_name", F.col("source_path").alias("path"))
    own = methods.groupBy("fqn").agg(F.collect_set("method_id").alias("method_ids"))  # those of one class
    rows = named.hint("merge").join(sources.where("content is not null").select("path", "content"), "path").join(own.hint("merge"), "fqn", "left")

    def run(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for fqn, simple, package, source, ids in zip(pdf["fqn"], pdf["simple_name"], pdf["package_name"], pdf["content"], pdf["method_ids"]):
                out.append((fqn, None, header_text(simple, package, source)))
                for i in [] if ids is None else ids:
                    out.append((fqn, i, method_text(simple, i.partition("#")[2] or i, source)))
            yield pd.DataFrame(out, columns=["fqn", "method_id", "text"]).astype({"method_id": object})

    importable(classes.sparkSession)
    return spread(rows.select("fqn", "simple_name", "package_name", "content", "method_ids"), "fqn").mapInPandas(run, "fqn string, method_id string, text string")


def extract(files: DataFrame) -> DataFrame:
    """files(path, content) -> rows of SCHEMA; a file that can't be read gives one row of kind error."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(x, {"extra": pa.list_(pa.string()), "number": pa.int32()}.get(x, pa.string())) for x in ("kind", "id", "owner", "name", "value", "extra", "number", "path")])
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += parse(path, content or "")
                except (IndexError, ValueError, RecursionError) as error:
                    rows.append(("error", path, path, type(error).__name__, str(error)[:200], [], None, path))
            columns = zip(*rows) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    importable(files.sparkSession)
    return spread(files.select("path", "content"), "path", "content").mapInArrow(run, SCHEMA)


def graph(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables of the code graph from extracted rows; calls and dependencies keep only ends that were extracted."""
    of = lambda kind: rows.where(F.col("kind") == kind)
    classes = of("class").select(
        F.col("id").alias("fqn"), F.col("name").alias("simple_name"), F.col("owner").alias("package_name"), F.nullif("value", F.lit("")).alias("super_class"),
        F.expr("slice(extra, 2, size(extra))").alias("labels"), (F.get("extra", F.lit(0)) == "enum").alias("is_enum"), F.col("path").alias("source_path"),
    ).dropDuplicates(["fqn"])
    methods = of("method").select(F.col("id").alias("method_id"), F.col("owner").alias("fqn"), "name", F.col("number").alias("complexity"), F.get("extra", F.lit(0)).cast("int").alias("writes")).dropDuplicates(["method_id"])
    sums = methods.groupBy("fqn").agg(F.sum("complexity").alias("complexity_sum"), F.max("complexity").alias("complexity_max"), (F.sum("writes") > 0).alias("has_db_writes"))
    known = classes.select(F.col("fqn").alias("dst"))
    depends = of("depends").select(F.col("owner").alias("src"), F.col("name").alias("dst"), F.col("value").alias("kind")).distinct().join(known, "dst", "left_semi").select("src", "dst", "kind")
    named = methods.select(F.col("method_id").alias("dst"), F.col("fqn").alias("target"), "name")
    reach = depends.select(F.col("src").alias("owner"), F.col("dst").alias("target")).unionByName(classes.select(F.col("fqn").alias("owner"), F.col("fqn").alias("target"))).distinct()
    calls = of("call").select(F.col("id").alias("src"), "owner", "name").join(reach, "owner").join(named, ["target", "name"]).select("src", "dst").distinct()
    return {
        "classes": classes.join(sums, "fqn", "left"), "methods": methods, "depends": depends, "calls": calls,
        "fields": of("field").select(F.col("id").alias("field_id"), F.col("owner").alias("fqn"), "name", F.col("value").alias("type")).dropDuplicates(["field_id"]),
        "extends": classes.where("super_class is not null").select(F.col("fqn").alias("src"), F.col("super_class").alias("dst")).join(known, "dst", "left_semi").select("src", "dst"),
        "implements": of("implements").select(F.col("owner").alias("src"), F.col("name").alias("dst")).distinct(),
        "annotations": of("annotation").select(F.col("owner").alias("fqn"), F.col("name").alias("annotation")).distinct(),
        "tables": of("table").select(F.col("owner").alias("src"), F.col("name").alias("dst")).distinct(),
        "queries": of("query_method").select(F.col("id").alias("method_id"), F.col("owner").alias("repository")).distinct(),
        "binds": of("binds").select(F.col("owner").alias("src"), F.col("name").alias("dst")).distinct(),
        "imports": of("import").select(F.col("owner").alias("fqn"), F.col("name").alias("import_name")).distinct(),
        "constants": of("constant").groupBy(F.col("owner").alias("fqn")).agg(F.array_sort(F.collect_set("name")).alias("constants")),
    }
