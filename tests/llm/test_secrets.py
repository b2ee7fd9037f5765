import hashlib
import random
import re

from treeline.llm import secrets as se


def plain(text):
    """The base rules as they are written, without any shortcut."""
    out = []
    rules = [(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, lambda m: len(m[2]) >= 6), ("AKIA[A-Z0-9]+", 1, lambda m: len(m[0]) >= 20), ("[0-9a-f]+", 2, lambda m: len(m[0]) >= 24)]
    for rule, kind, good in rules:
        out += [(m.start(), kind, m.end()) for m in re.finditer(rule, text) if good(m)]
    return ",".join(f"{se.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


CASES = [
    "", "token: abc", "Token:abcdef", "API_KEY = 'abcdef'", "apikey=\"abc.def/=+-_\"", "password=token=secret=abcdef", "xAKIA" + "B" * 15, "AKIA" + "B" * 16 + "AKIA", "0" * 23 + "g" + "a" * 24, "ſecret=abcdef1 toKen=abcdef",
    "é password : hunter22", "secret\t=abcdef", "secret=\n abcdef", "AKIAAKIA" + "Z" * 20,
]


def test_base_spans(docs, odd_docs, no_docs):
    for text in [*CASES, *(r.text for r in docs.collect())]:
        assert se._named(se.base_spans(text)) == plain(text), text[:80]
    got = se.find_secrets(odd_docs).collect()
    assert len(got) == odd_docs.count() and se.find_secrets(no_docs).count() == 0
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in got:
        assert r.base_sha256 == hashlib.sha256(plain(texts[r.doc_id]).encode()).hexdigest()
    assert [r.n_access for r in got if r.doc_id == 13] == [1]


S = "Zk81qq72mm10"
LEXED = {
    'KEY = "s3cr3t-value-99x"\ndb_pwd = KEY\n':["s3cr3t-value-99x"],
    '{"client_secret": "a8f5k2l9x0q1"}':["a8f5k2l9x0q1"],
    "export AUTH_TOKEN=zx81kq72mm10pp\n":["zx81kq72mm10pp"],
    'title = "the quick brown fox"\npassword = "changeme"\npwd = "${PWD_VAR}"\n':[],
    "if a == b: pass":[],
    f'password: str = "{S}"':[S],
    f'db_pwd: Optional[str] = "{S}"':[S],
    f'let password: &str = "{S}";':[S],
    f"const DB_PWD: &'static str = \"{S}\";":[S],
    f'var dbPwd string = "{S}"':[S],
    f'final String dbPassword = "{S}";':[S],
    f'char *password = "{S}";':[S],
    f'const char password[] = "{S}";':[S],
    f'db.setPassword("{S}");':[S],
    f'<password>{S}</password>':[S],
    f'<db:password enc="no"> {S} </db:password>':[S],
    f'<user name="x" password="{S}"/>':[S],
    f'<add key="DbPassword" value="{S}" />':[S],
    f'password = """{S}"""':[S],
    f"pwd = '''\n{S}\nline two 99'''":[f"\n{S}\nline two 99"],
    f'password = KEY\nKEY = "{S}"':[S],
    f'a = "{S}"\nb = a\nc = b\npassword = c':[S],
    f'PASSWORD = "ab81kk" + "cd92xx"':["ab81kk","cd92xx"],
    f'PASSWORD = ("ab81kk"\n   "cd92xx")':["ab81kk","cd92xx"],
    f'A = "ab81kk"\nB = "cd92xx"\npassword = A + B':["ab81kk","cd92xx"],
    f'let token = String::from("{S}");':[S],
    f'let token = "{S}".to_string();':[S],
    f'password = os.environ["DB_PASSWORD"]':[],
    f'password = os.getenv("DB_PASSWORD")':[],
    f'props.put("db.password", "{S}")':[S],
    f'cfg["db"]["password"] = "{S}"':[S],
    f'mysql --password {S} -h x':[S],
    f'tool --auth-token={S}':[S],
    f'db.password={S}\n':[S],
    f'password: {S}\n':[S],
    f"password: '{S}' # note\n":[S],
    f'password = /* old one */ "{S}"':[S],
    f'// password = "{S}"':[S],
    f'/* password = "{S}" */':[S],
    f'password = r#"{S}"#;':[S],
    f'password = b"{S}"':[S],
    f'password := "{S}"':[S],
    f'"password" => "{S}",':[S],
    f'password = `{S}`':[S],
    'password_'+'x'*200+f' = "{S}"':[S],
    f'private_key = -----BEGIN':[],
    f"don't worry, it's the user's password's fault: nothing":[],
    f'x = y\ny = x\npassword = x':[],
    f'Connect with password {S}':[],
    f'password = "${{DB}}"\n':[],
    f'user = "bob", pwd = "{S}", host = "h"':[S],
    f'f(password="{S}", user="x")':[S],
    f'secret: [ "{S}" ]':[S],
    f'db_pwd = c ? "{S}" : ""':[S],
    f'db_pwd = f() or "{S}"':[S],
    f'db_pwd = os.environ.get("X") || "{S}"':[S],
    f'db_pwd = "{S}" if c else "q9w8e7r6t5y4"':[S,"q9w8e7r6t5y4"],
    f'user, db_pwd = "robert.smith1", "{S}"':[S],
    f'db_pwd += "{S}"':[S],
    f'if db_pwd == "{S}":':[S],
    f'if "{S}" == db_pwd {{':[S],
    f'api_keys = ["{S}", "q9w8e7r6t5y4"]':[S,"q9w8e7r6t5y4"],
    f'secrets = {{"db": "{S}", "n": 3}}':[S],
    f'titles = {{"db": "{S}"}}':[],
    "let db_pwd: M<" + ", ".join(f"Type{k}" for k in range(60)) + f'> = "{S}";':[S],
    "var dbPwd map[string]" + "Long" * 80 + f' = "{S}"':[S],
    "db_pwd = " + "wrap(" * 9 + f'"{S}"' + ")" * 9:[S],
    "db_pwd = " + "w((" * 400 + f'"{S}" + "tail"' + "))" * 400:[S,"tail"],
}


def test_lexed_pairs_and_constants():
    for text, want in LEXED.items():
        assert [text[a:b] for a, b in se.lexed_spans(text)] == want, text


def test_lexer_never_fails_and_spans_lie_in_the_text():
    draw = random.Random(6)
    marks = ["password", "token", "=", ":", "'", '"', '"""', "`", "(", ")", "<", ">", "</", "/*", "*/", "//", "#", "[", "]", "+", "\n", "\\", "x1", S, "--", "::", " ", "r#", "key", "é", "&"]
    for _ in range(3000):
        text = "".join(draw.choice(marks) for _ in range(draw.randrange(1, 25)))
        assert all(0 <= a < b <= len(text) for a, b in se.lexed_spans(text))
    assert se.lexed_spans("password = (" * 3000) == [] and se.lexed_spans("a = b\n" * 3000 + "password = a") == []
    chain = "".join(f"n{k} = n{k + 1}\n" for k in range(300)) + f'n300 = "{S}"\npassword = n0\n'
    assert [chain[a:b] for a, b in se.lexed_spans(chain)] == [S]


def test_types_are_found_as_by_a_scan_from_every_token():
    """The one pass over all tokens against a scan from each, on random texts."""

    def scanned(tokens, k):
        depth = 0
        for j in range(k, len(tokens)):
            t = tokens[j]
            mark = t.kind in ("mark", "op")
            if depth == 0 and t.kind == "op" and t.text in ("=", ":="):
                return j if j > k else 0
            if mark and t.text in ("[", "(", "<"):
                depth += 1
            elif mark and t.text in ("]", ")", ">", ">>"):
                depth -= 2 if t.text == ">>" else 1
                if depth < 0:
                    return 0
            elif t.kind in ("text", "end") or (t.kind == "mark" and t.text not in "&*.?'" and not (depth and t.text == ",")) or (t.kind == "op" and t.text not in ("|", "::", "->", "?", ":")):
                return 0
        return 0

    draw = random.Random(8)
    marks = ["a", "b", "<", ">", ">", "[", "]", "(", ")", ",", "=", ":", "&", "*", "::", "->", "|", "\n", '"x"', ">>", ";", "=="]
    for _ in range(4000):
        text = " ".join(draw.choice(marks) for _ in range(draw.randrange(1, 16)))
        tokens = se._tokens(text, 0, len(text))[0]
        reader = se._Reader(text, tokens)
        assert [reader.after_type(k) for k in range(len(tokens))] == [scanned(tokens, k) for k in range(len(tokens))], text


def test_long_lines_are_read_in_time():
    import time

    begun = time.monotonic()
    for text in ("word " * 60_000 + "= token", "token " * 60_000, "a < " * 30_000 + "= token", "x = (" * 20_000 + "token", "token = [" + "'abc', " * 30_000, "token = a ? " * 10_000, "token(" * 20_000 + '"v"'):
        se.lexed_spans(text)
    assert time.monotonic() - begun < 60


def test_redaction(odd_docs):
    assert se.redact("x password=abcdef1 y") == "x [SECRET] y"
    assert se.redact("nothing here: at all") == "nothing here: at all"
    before, after = odd_docs.collect(), se.redact_secrets(odd_docs).collect()
    assert len(before) == len(after) and after[0].asDict().keys() == before[0].asDict().keys()
    changed = [r for r in after if "[SECRET]" in (r.text or "")]
    assert [r.doc_id for r in changed] == [13] and changed[0].n_chars == len(changed[0].text)
