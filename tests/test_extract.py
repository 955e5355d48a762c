import json

import pytest

from weftline.extract import build, project
from weftline.extract.facts import facts, host_of, summary
from weftline.extract.tokens import tokenize


def made(spark, files, semantic=True):
    files = {"src/a.ts": files} if isinstance(files, str) else files
    graph = build.build(spark.createDataFrame(list(files.items()), "path string, text string"), semantic)
    nodes = {r["id"]: r.asDict() | {"metadata": json.loads(r["metadata"])} for r in graph.nodes.collect()}
    edges = [(r["kind"], r["src"], r["dst"], json.loads(r["metadata"])) for r in graph.edges.collect()]
    return nodes, edges


def between(edges, kind, a, b):
    return [m for k, s, d, m in edges if k == kind and a in s and b in d]


#: One file for each case, told apart by name, so that one graph serves all of them.
CASES = {
    "one_fetch": "export function f() { return fetch('https://api.example.com/users'); }",
    "two_fetches": "export function f() {\n\tfetch('https://h2.example.com/a');\n\tfetch('https://h2.example.com/b?x=1');\n}",
    "template": "export function f() { return fetch(`https://h3.example.com/users`); }",
    "dynamic": "export function f(base: string, url: string) {\n\tfetch(`${base}/users`);\n\tfetch(url);\n}",
    "relative": "export function f() { return fetch('/api/users'); }",
    "global": "export function f() { window.fetch('https://a.example.com:8080/x'); return globalThis.fetch('https://b.example.com/x'); }",
    "own_fetch": "export class Repo { fetch(): void {} load(): void { this.fetch(); } }\nexport function f(repo: { fetch(): void }) { repo.fetch(); }",
    "nested_fetch": "export function outer() {\n\tfunction inner() { return fetch('https://api.example.com/x'); }\n\treturn inner;\n}",
    "flag": "export function f(): string { return process.env.PORT + process.env['PORT']; }\nexport const P = process.env.HOST;\nexport class S { start(): boolean { return process.env.DEBUG !== undefined; } }",
    "computed": "export function f(k: string): string | undefined { return process.env[k]; }",
    "routes": "export function listUsers(req: unknown, res: unknown): void {}\nexport function routes(app: { get: (p: string, h: unknown) => void }): void {\n\tapp.get('/users', listUsers);\n}",
    "arrow_route": "export const getUser = (req: unknown, res: unknown): void => {};\nclass Ctrl { create(req: unknown, res: unknown): void {} }\nconst c = new Ctrl();\nexport function routes(r: any): void { r.get('/u/:id', getUser); r.post('/u', c.create); }",
    "inline_route": "export function h(req: unknown, res: unknown): void {}\nfunction logger(): void {}\nexport function routes(r: any): void {\n\tr.put('/a', () => {});\n\tr.delete('/b', logger, h);\n}",
    "no_route": "export function routes(app: any): void {\n\tapp.get('/setting');\n\tconst m = new Map<string, number>();\n\tm.get('key');\n\tapp.post('/skip', 42);\n}",
    "writes": "export let counter = 0;\nexport const SOURCE = 5;\nexport function reset(): void { counter = 0; counter = 1; }\nexport function read(): number { return SOURCE + 1; }\nexport function copy(): void { counter = SOURCE; }\nexport function add(): void { counter += 5; }\nexport function tick(): void { counter++; }",
    "arrows": "export function target(): number { return 1; }\nexport const caller = (): number => target();\nexport class Widget {}\nexport const make = () => new Widget();",
    "callback": "export function seed(): void {}\nfunction test(name: string, fn: () => void): void {}\ntest('logs in', () => { seed(); });",
    "method": "export function helper(): void {}\nexport class C { run(): void { helper(); helper(); } }",
    "exports": "export function shown(): void {}\nexport const value = 1;\nexport class Widget { render(): void {} count = 0; }\nexport interface Shape {}\nexport type Id = string;\nexport enum Color { Red }\nfunction hidden(): void {}\nconst listed = 1;\nexport { listed };",
    "shadow": "export let x = 1;\nexport function f(x: number): number { return x; }\nexport function g(): number { const { x } = { x: 2 }; return x; }\nexport function h(): number { for (const x of [1]) { return x; } return 0; }",
    "heritage": "export interface Shape { area(): number }\nexport class Base { name(): string { return ''; } }\nexport class Mid extends Base {}\nexport class Leaf extends Mid implements Shape { area(): number { return 1; } name(): string { return super.name(); } }",
    "types": "export interface A { b: B }\nexport type B = { a: A; c?: C[] };\nexport enum C { X }\nexport function f(a: A, b: Array<B>): Promise<C | null> { return null as any; }\nexport const v: Map<string, A> = new Map();\nexport function g<A>(a: A): A { return a; }",
    "overload": "export function f(a: string): void;\nexport function f(a: number): void;\nexport function f(a: any): void { }\nexport class K { m(a: string): void;\n\tm(a: any): void {} }",
}


@pytest.fixture(scope="module")
def cases(spark):
    return made(spark, {f"src/{k}.ts": v for k, v in CASES.items()})


def kinds(nodes, case, kind):
    return [n for n in nodes.values() if n["kind"] == kind and n["file_path"] == f"src/{case}.ts"]


def test_hosts(cases):
    nodes, edges = cases
    assert nodes["Api:api.example.com"]["name"] == "api.example.com"
    assert between(edges, "CALLS_EXTERNAL", "one_fetch.ts#f@", "Api:api.example.com") == [{"count": 1}]
    assert between(edges, "CALLS_EXTERNAL", "two_fetches.ts#f@", "Api:h2.example.com") == [{"count": 2}]
    assert between(edges, "CALLS_EXTERNAL", "template.ts#f@", "Api:h3.example.com")
    assert between(edges, "CALLS_EXTERNAL", "dynamic.ts#f@", "Api:(dynamic)") == [{"count": 2}]
    assert between(edges, "CALLS_EXTERNAL", "relative.ts#f@", "Api:(dynamic)")
    assert between(edges, "CALLS_EXTERNAL", "global.ts#f@", "Api:a.example.com:8080") and between(edges, "CALLS_EXTERNAL", "global.ts#f@", "Api:b.example.com")
    assert not between(edges, "CALLS_EXTERNAL", "own_fetch.ts", "")
    assert between(edges, "CALLS_EXTERNAL", "nested_fetch.ts#outer@", "Api:") and not between(edges, "CALLS_EXTERNAL", "#inner@", "")
    assert host_of("HTTPS://u:p@Ex.com:443/a") == "ex.com" and host_of("mailto:a@b") == "(dynamic)"


def test_flags(cases):
    nodes, edges = cases
    assert nodes["Config:PORT"]["file_path"] == "process.env"
    assert between(edges, "READS_CONFIG", "flag.ts#f@", "Config:PORT") == [{"count": 2}]
    assert between(edges, "READS_CONFIG", "VariableDeclaration:src/flag.ts#P@", "Config:HOST") and between(edges, "READS_CONFIG", "flag.ts#start@", "Config:DEBUG")
    assert not between(edges, "READS_CONFIG", "computed.ts", "")


def test_routes(cases):
    nodes, edges = cases
    assert nodes["Endpoint:GET /users"]["name"] == "GET /users"
    assert between(edges, "HANDLES", "Endpoint:GET /users", "routes.ts#listUsers@")
    assert between(edges, "HANDLES", "Endpoint:GET /u/:id", "#getUser@") and between(edges, "HANDLES", "Endpoint:POST /u", "#create@")
    assert "Endpoint:PUT /a" in nodes and not between(edges, "HANDLES", "Endpoint:PUT /a", "")
    assert between(edges, "HANDLES", "Endpoint:DELETE /b", "#h@")
    assert not kinds(nodes, "no_route", "Endpoint")


def test_reads_and_writes(cases):
    _, edges = cases
    at = lambda kind, f, t: between(edges, kind, f"writes.ts#{f}@", f"writes.ts#{t}@")
    assert at("WRITES", "reset", "counter") == [{"count": 2}] and not at("READS", "reset", "counter")
    assert at("READS", "read", "SOURCE") and not at("WRITES", "read", "SOURCE")
    assert at("WRITES", "copy", "counter") and at("READS", "copy", "SOURCE") and not at("READS", "copy", "counter")
    for name in ("add", "tick"):
        assert at("WRITES", name, "counter") and at("READS", name, "counter")
    assert not [e for e in edges if e[0] in ("READS", "WRITES") and "shadow.ts#x@" in e[2]]


def test_callers(cases):
    _, edges = cases
    assert between(edges, "CALLS", "arrows.ts#caller@", "#target@") and between(edges, "INSTANTIATES", "#make@", "#Widget@")
    assert between(edges, "CALLS", "Module:src/callback.ts", "#seed@")
    assert between(edges, "CALLS", "method.ts#run@", "#helper@") == [{"count": 2}]
    assert between(edges, "CALLS", "own_fetch.ts#load@", "own_fetch.ts#fetch@")


def test_exports(cases):
    nodes, edges = cases
    out = {d.split("#")[1].split("@")[0] for k, s, d, _ in edges if k == "EXPORTS" and s == "Module:src/exports.ts"}
    assert out == {"shown", "value", "Widget", "Shape", "Id", "Color", "listed"}
    assert nodes["VariableDeclaration:src/exports.ts#listed@8"]["exported"] and not nodes["FunctionDeclaration:src/exports.ts#hidden@7"]["exported"]


def test_heritage_and_overrides(cases):
    _, edges = cases
    assert between(edges, "EXTENDS", "#Leaf@", "#Mid@") and between(edges, "EXTENDS", "#Mid@", "#Base@") and between(edges, "IMPLEMENTS", "#Leaf@", "#Shape@")
    assert between(edges, "OVERRIDES", "heritage.ts#name@4", "heritage.ts#name@2") and between(edges, "OVERRIDES", "MethodDeclaration:src/heritage.ts#area@", "MethodSignature:src/heritage.ts#area@")
    assert between(edges, "CALLS", "heritage.ts#name@4", "heritage.ts#name@2")


def test_types(cases):
    _, edges = cases
    at = lambda kind, f, t: between(edges, kind, f"types.ts#{f}@", f"types.ts#{t}@")
    assert at("PARAM_TYPE", "f", "A") and at("PARAM_TYPE", "f", "B") and at("RETURNS", "f", "C") and at("USES_TYPE", "v", "A")
    assert at("USES_TYPE", "b", "B") and at("USES_TYPE", "B", "A") and at("USES_TYPE", "B", "C")
    assert not at("PARAM_TYPE", "g", "A") and not at("RETURNS", "g", "A")


def test_overloads_are_one_declaration(cases):
    nodes, _ = cases
    assert [n["start_line"] for n in kinds(nodes, "overload", "Function")] == [3] and [n["start_line"] for n in kinds(nodes, "overload", "Method")] == [5]


def test_names_across_files(spark):
    nodes, edges = made(
        spark,
        {
            "src/lib/math.ts": "export function add(a: number): number { return a; }\nexport default class Tool { use(): void {} }\nexport const ZERO = 0;",
            "src/lib/index.ts": "export * from './math.js';\nexport { default as Tool, add as plus } from './math';\nimport { helper } from '../helper';\nexport { helper as aid };",
            "src/helper.tsx": "export class Store { tool: Tool = new Tool(); static open(): Store { return new Store(); } run(): void { this.tool.use(); this.more(); }\n more() {} }\nimport Tool from './lib/math';\nexport const helper = () => 1;",
            "src/main.ts": "import { plus, Tool, ZERO, aid } from './lib';\nimport * as lib from './lib/index.js';\nimport { Store } from './helper';\nimport { readFile } from 'node:fs';\nimport './gone';\n"
            "export function main(s: Store) { plus(ZERO); lib.add(1); new Tool().use(); const t = new Tool(); t.use(); Store.open().run(); s.run(); aid(); readFile; new lib.Tool(); }\nexport class Sub extends Store { go() { this.run(); } }",
            "node_modules/x/index.ts": "export const no = 1;", "src/types.d.ts": "declare const no: number;", "readme.md": "# no",
        },
    )
    assert {n["file_path"] for n in nodes.values() if n["kind"] == "Module"} == {"src/lib/math.ts", "src/lib/index.ts", "src/helper.tsx", "src/main.ts"}
    main = "main.ts#main@"
    assert between(edges, "CALLS", main, "math.ts#add@") == [{"count": 2}]
    assert between(edges, "INSTANTIATES", main, "math.ts#Tool@") == [{"count": 3}] and between(edges, "CALLS", main, "math.ts#use@") == [{"count": 2}]
    assert between(edges, "CALLS", main, "helper.tsx#open@") and between(edges, "CALLS", main, "helper.tsx#run@") and between(edges, "CALLS", main, "helper.tsx#helper@")
    assert between(edges, "CALLS", "helper.tsx#run@", "math.ts#use@") and between(edges, "CALLS", "main.ts#go@", "helper.tsx#run@")
    assert between(edges, "READS", main, "math.ts#ZERO@")
    assert between(edges, "IMPORTS", "Module:src/main.ts", "Module:src/lib/index.ts") == [{"specifier": "./lib", "count": 2}]
    assert between(edges, "IMPORTS", "Module:src/main.ts", "External:node:fs") == [{"specifier": "node:fs", "count": 1}] and between(edges, "IMPORTS", "Module:src/main.ts", "External:./gone")
    assert nodes["External:node:fs"]["kind"] == "ExternalModule"
    known = set(nodes)
    assert all(s in known and d in known for _, s, d, _ in edges)


def test_structure_alone(spark):
    nodes, edges = made(spark, "/** The default port. */\nexport const PORT = 8080;\nexport function f(a: number) { return PORT; }\nf(1);", semantic=False)
    assert {k for k, *_ in edges} == {"CONTAINS", "EXPORTS"} and nodes["VariableDeclaration:src/a.ts#PORT@2"]["metadata"] == {"documentation": "The default port."}
    assert {n["kind"] for n in nodes.values()} == {"Module", "Variable", "Function", "Parameter"}
    assert between(edges, "CONTAINS", "#f@3", "Parameter:src/a.ts#a@3")


def test_no_files_and_odd_files(spark):
    empty = build.build(spark.createDataFrame([], "path string, text string"), True)
    assert empty.nodes.count() == 0 and empty.edges.count() == 0
    nodes, _ = made(spark, {"a.ts": None, "b.ts": "", "c.ts": "export class { ( [ '`${", "d.ts": "const s = `a${`b${1}`}`; export const after = /[/]'/.test('x') ? 1 / 2 : 3;", "e.ts": "x" * 200_000, "f.ts": "(" * 3000})
    assert set(nodes) >= {f"Module:{x}.ts" for x in "abcdef"} and "VariableDeclaration:d.ts#after@1" in nodes


@pytest.mark.parametrize(
    "comment, want",
    [
        ("/** Adds two numbers. */", "Adds two numbers."), ("/**\n * @param a the addend\n */", None), ("/**\n * Parses the input\n * across two lines.\n *\n * This second paragraph is dropped.\n */", "Parses the input across two lines."),
        ("/** Wraps {@link Document} values. */", "Wraps Document values."), ("/** See {@link Document | the document} for details. */", "See the document for details."), (None, None), ("/** */", None),
    ],
)
def test_documentation(comment, want):
    assert summary(comment) == want


def test_long_documentation_is_cut():
    assert len(summary("/** " + "word " * 200 + "*/")) <= 400 and summary("/** " + "word " * 200 + "*/").endswith("…")


def test_lines_of_multiline_tokens():
    tokens, _, _ = tokenize("`a\nb`\nfoo /* x\n y */ 'z'")
    assert [(t.text, t.line, t.end_line) for t in tokens] == [("`a\nb`", 1, 2), ("foo", 3, 3), ("'z'", 4, 4)]
    end = [r["end_line"] for r in facts("a.ts", "export function f(\n a: number,\n): void {\n}\n") if r.get("kind") == "Function"]
    assert end == [4]


@pytest.mark.parametrize(
    "remote, want",
    [
        ("git@github.com:owner/repo.git", "https://github.com/owner/repo"), ("https://github.com/owner/repo", "https://github.com/owner/repo"), ("ssh://git@github.com/owner/repo.git", "https://github.com/owner/repo"),
        ("  https://github.com/owner/repo/  ", "https://github.com/owner/repo"), ("git@github.example.com:owner/repo.git", "https://github.example.com/owner/repo"), ("git@gitlab.com:owner/repo.git", None), ("not a url", None), ("https://github.com/owner", None),
    ],
)
def test_remotes(remote, want):
    assert project.github_base_url(remote) == want


def test_a_project_on_disk(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "deep" / "ä b.ts").write_text("export const ünï = 1;\n")
    (tmp_path / "src" / "x.d.ts").write_text("declare const y: number;")
    (tmp_path / "node_modules" / "p").mkdir(parents=True)
    (tmp_path / "node_modules" / "p" / "i.ts").write_text("export const z = 1;")
    found = project.sources(spark, str(tmp_path)).collect()
    assert [(r["path"], r["text"]) for r in found] == [("src/deep/ä b.ts", "export const ünï = 1;\n")]
    assert project.provenance(str(tmp_path)) is None
