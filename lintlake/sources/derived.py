"""Corpora derived from the given tables, used by the registered queries, tests and bench.

``code_files``: one source file per row of ``orders``. The order key chooses the blocks, the
customer key chooses folder and language. It is a projection of ``orders``: no shuffle, and no
key can make a file long. ``text_files``: the texts of ``documents`` and ``pages`` as HTML files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.sources.local import spread

ROOT = "/corpus"
LONG = 32
DIRS = ["src", "lib/core", "node_modules/m", "app", "pkg/vendor", "test", "src/ui", "build/out", "app/api", "tools", "lib", "src/db"]
EXTS = ["js", "ts", "py", "js", "ts", "go", "js", "ts", "py", "java", "rs", "sql", "sh", "rb", "c", "cs", "php", "kt", "py", "txt"]

# '@' becomes a number of the order and the block
BLOCKS = [
    "function calc@(a) {\n  var kept@ = a;\n  if (a == 42) {\n    return kept@;\n  }\n}",
    'const joined@ = "x" + "SELECT id FROM t";',
    'api_key = "abcd@zz";',
    "eval(input@);\n// eval(skipped@);\néeval(odd@);",
    "for (a of b) {\n  while (c) {\n    for (d of e) {\n      go@(d);\n    }\n  }\n}",
    "try {\n  load@();\n} catch (e) {\n}",
    "def read@(p, acc=[]):\n    try:\n        h = open(p)\n    except:\n        pass\n    return acc\n    acc.clear()",
    "async function pull@(u) {\n  const r1 = await get(u);\n  const r2 = await get(u);\n  return r1;\n}",
    "switch (code@) {\n  case 1: break;\n}",
    "// TODO: tidy block @\n# FIXME look at @",
    "val@, _ := fetch(k)\ngo func() { work@() }()",
    "let v@ = parse(s).unwrap();",
    "SELECT * FROM t@;",
    "setInterval(tick@, 5);\nel.addEventListener('evt@', h);",
    "  const total@ = price@ * quantity;\n  const taxed@ = total@ * rate + 3;\n  const label@ = makeLabel(taxed@, 'abc');\n"
    "  const shown@ = render(label@, total@);\n  const final@ = finish(shown@, taxed@);",
    "echo ${name}; ls @\nconsole.log(msg@);\ndebugger;",
    "const parsed@ = JSON.parse(raw@);\nlet n@ = parseInt(s@);\nlet m@ = parseInt(s@, 10);",
    "try {\n  const safe@ = JSON.parse(raw);\n  use(safe@);\n} catch (e) {\n  log(e);\n}",
    "const [p@, q@] = rows;\nif (rows.length) {\n  const [r@] = rows;\n}",
    "items.forEach(x => {\n  setTimeout(() => go(x), 10);\n});\nsetTimeout(later@, 99);",
    "import { Component } from '@angular/core';\n@Component({ selector: 'c@' })\nexport class C@ {\n  constructor(private a: A) {\n  }\n}",
    "const app@ = require('express')();\napp.get('/a@', (req, res) => {\n  res.redirect(req.query.to);\n});",
    "function grow@(x) {\n  if (a&&b) { return 1; }\n  for (;;) { if (x||y) break; }\n  while (x) { x = f(x); }\n"
    "  switch (x) {\n    case 1: go();\n    case 2: go();\n    default: go();\n  }\n}",
    "function open@(x) {\n  if (x) {\n    y@ = x;",
    "} else {\n  z@ = [1];\n}",
    "class K@:\n    def one(self, n):\n        if n and n > 31:\n            return n\n\n        for i in range(n):\n            print(i)\n"
    "    def two(self):\n        q = 5\n        return q",
    "for (let i = 0; i < n; i++) { s += 'x@'; }\nlist.map(u => db.query(`select @`));",
    "element.innerHTML = data@;\nif (element.innerHTML == data@) { alert(1); }",
    "p@.then(r => r.json());\np@.then(r => r.json()).catch(log);\nnew Promise(go@).finally(done);",
    "while (busy@) { r = new RegExp('a@'); }\nfs.readFileSync('f@');\nconst copy = all.map(o => ({ ...o, id: @ }));",
    "el@.addEventListener('click', f);\nel@.removeEventListener('click', f);\nel@.addEventListener(\"key\", g);",
    "requests.get(u, verify=False)\npickle.loads(blob@)\nos.system('ls ' + d@)\nfrom os import *\nx = a[@]\nh = hashlib.md5(x)",
    "System.out.println(o@.name());\nRuntime.getRuntime().exec(\"ls \" + d@);\nint t@ = 7;\nchar *b = malloc(8);\nm := table[k@]",
    "await save@();\nrefresh@();\nload@() // later\nconst v = a as T | B;\nconst w = a as Thing;",
    "let\n  split@ = 1;\nvar x@ = y / z;\nasync\nfunction far@() {\n  await go();\n}",
    "token = 'ghp_abcdefghijklmnopqrstuvwxyz0123456789'\nheaders['Access-Control-Allow-Origin'] = '*'\npath = '../up@'",
    "export const useIt@ = () => {\n  const [s, set] = useState(0);\n  return (\n    <p>{s}</p>\n  );\n};",
    "  const first@ = compute(alpha, 'one');\n  const second@ = compute(beta, \"two\");\n  const third@ = compute(gamma, `three`);\n"
    "  const fourth@ = combine(first@, 12);\n  const fifth@ = combine(second@, 34);\n  const sixth@ = combine(third@, 56);",
    "function tall@(k) {\n" + "".join(f"  step(k, {n});\n" for n in range(10, 62)) + "}",
    "rescue\nensure\nend\nif (a == b || c === d) { e = f == g; }\nreturn 77;\n}\n\nunreached@();",
]


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey, content."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    orders = spread(orders)
    key = F.col("o_orderkey")
    blocks = F.array(*[F.lit(b) for b in BLOCKS])
    picked = F.transform(F.sequence(F.lit(0), (key % 5).cast("int")), lambda k: F.replace(
        F.get(blocks, ((key + k * (key % 7)) % len(BLOCKS)).cast("int")), F.lit("@"), (key * 10 + k).cast("string")))
    return orders.select("o_orderkey", "o_custkey", F.array_join(picked, "\n").alias("content"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    folder = F.get(F.array(*[F.lit(d) for d in DIRS]), (F.floor(cust / len(EXTS)) % len(DIRS)).cast("int"))
    ext = F.get(F.array(*[F.lit(e) for e in EXTS]), (cust % len(EXTS)).cast("int"))
    return _code(spark, sf_dir).select(F.concat(F.lit(f"{ROOT}/"), folder, F.lit("/f"), key.cast("string"), F.lit("."), ext).alias("path"), "content")


def long_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same code, the files of LONG keys in a row joined to one of several hundred lines."""
    joined = _code(spark, sf_dir).groupBy(F.floor(F.col("o_orderkey") / LONG).cast("long").alias("g")).agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "content"))).alias("parts"))
    ext = F.get(F.array(*[F.lit(e) for e in EXTS]), (F.col("g") % len(EXTS)).cast("int"))
    return joined.select(F.concat(F.lit(f"{ROOT}/long/g"), F.col("g").cast("string"), F.lit("."), ext).alias("path"),
        F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("content"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = spread(docs).select(
        F.concat(F.lit("docs/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("text").alias("content"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = spread(pages).select(
        F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return docs.unionByName(pages)
