"""A small corpus of code for the rule queries; no table holds source code."""

#: id, family, context, code
SNIPPETS = [
    (1, "XSS", "", "const el = document.getElementById('a');\nel.innerHTML = userInput;\n"),
    (2, "XSS", "", "el.innerHTML = '<b>fixed</b>';"),
    (3, "XSS", "", "el.innerHTML ='plain';"),
    (4, "XSS", "const DOMPurify = require('dompurify');", "el.innerHTML = DOMPurify.sanitize(x) + DOMPurify(x);"),
    (5, "XSS", "", "// el.innerHTML = x\nel.textContent = x;"),
    (6, "XSS", "", "document.write(name)\ndocument.write('fixed')"),
    (7, "XSS", "", "el.outerHTML = tpl"),
    (8, "SQL Injection", "", "def find(c, n):\n    c.execute(\"SELECT * FROM t WHERE n='\" + n)\n"),
    (9, "SQL Injection", "", "def find(c, n):\n    c.execute(\"SELECT * FROM t WHERE n=%s\", (n,))\n"),
    (10, "SQL Injection", "", "def find(c, n):\n    c.execute(\"SELECT * FROM t WHERE n=?\")\n"),
    (11, "SQL Injection", "", "q = f'{t} x SELECT 1'"),
    (12, "Insecure Cryptography", "", "const apiToken = 'k' + Math.random();"),
    (13, "Insecure Cryptography", "", "const hue = Math.random() * 360;"),
    (14, "Insecure Cryptography", "const crypto = require('crypto');", "const token = crypto.randomBytes(16).toString('hex');"),
    (15, "Insecure Cryptography", "const { randomBytes } = require('crypto');", "const t = randomBytes(16);"),
    (16, "Insecure Cryptography", "", "const t = randomUUID();"),
    (17, "Insecure Cryptography", "", "h = hashlib.md5(data)\nprint(h)"),
    (18, "Path Traversal", "", "const p = path.resolve(base, name);\nif (path.relative(base, p).startsWith('..')) throw e;\nfs.readFile(p);"),
    (19, "Path Traversal", "", "const p = path.resolve(base, name);\nif (!p.startsWith(base)) throw e;\nfs.readFile(p);"),
    (20, "Path Traversal", "", "const p = path.resolve(base, name);\nif (path.relative(base, p)) ok();\nfs.readFile(name);"),
    (21, "Path Traversal", "", "open('../' + name)"),
    (22, "OS Command Injection", "", "import os\nos.system('ls ' + d)\n"),
    (23, "OS Command Injection", "", "subprocess.run(['ls', d])"),
    (24, "OS Command Injection", "", "subprocess.run(c, shell = True)"),
    (25, "Insecure Deserialization", "", "import pickle\nx = pickle.loads(b)\ny = eval (s)\n"),
    (26, "Insecure Deserialization", "", "x = yaml.load(s)"),
    (27, "Insecure Deserialization", "", "x = yaml.load(s, Loader=yaml.SafeLoader)"),
    (28, "XML Injection", "", "p = etree.XMLParser(resolve_entities=False)"),
    (29, "XML Injection", "", "doc = minidom.parse(f)"),
    (30, "CSRF", "", "app.post('/pay', (req, res) => {\n  if (!csrfToken) return;\n  pay();\n});"),
    (31, "CSRF", "", "const a = req.body.csrf;\nif (a === req.headers.csrf) ok();"),
    (32, "CSRF", "app.use(csrfProtection)", "router.post('/x', csrfProtection, h);\nfetch('/y')"),
    (33, "CSRF", "", "if (req.session.csrfSecret !== t) deny();"),
    (34, "CSRF", "", "if (csrfA == csrfA) ok();"),
    (35, "Unknown", "", "nothing here"),
    (36, "XSS", "", ""),
    (37, "SQL Injection", "", "x = 1 # TODO finish"),
    (38, "SQL Injection", "", "call_something_with_a_long_line();\ncall_something_with_a_long_line();\ncall_something_with_a_long_line();\n"),
]

#: natural-language rules, for the same operators over documents
WORD_RULES = {"XSS": ("licensed", "token"), "SQL Injection": ("the of",), "CSRF": ("password", "secret =")}


def snippets(spark):
    return spark.createDataFrame(SNIPPETS, "id int, family string, context string, code string")

_BODY = "def load(request, name):\n    value = request.args.get('name')\n    rows = []\n    total = 0\n"

#: id, vulnerable text, fixed text
PAIRS = [
    (1, _BODY + "    cursor.execute('SELECT a FROM t WHERE n = ' + value)\n    return rows, total\n", _BODY + "    cursor.execute('SELECT a FROM t WHERE n = %s', (value,))\n    return rows, total, value\n"),
    (2, _BODY + "    data = pickle.loads(value)\n    return data, rows\n", _BODY + "    data = json.loads(value)\n    check(data)\n    return data, rows\n"),
    (3, _BODY + "    data = pickle.loads(value)\n    return data, rows\n", _BODY + "    data = pickle.loads(value)\n    return data, rows, total\n"),
    (4, _BODY + "    return open('../files/' + value).read()\n", _BODY + "    path = os.path.realpath(value)\n    if not path.startswith(BASE):\n        raise ValueError(path)\n    return open(path).read()\n"),
    (5, _BODY + "    return '<p>' + value + '</p>', rows, total\n", _BODY + "    return '<p>' + escape(value) + '</p>', rows, total\n"),
    (6, _BODY + "    tree = etree.fromstring(value)\n    return tree\n", _BODY + "    parser = etree.XMLParser(resolve_entities=False)\n    tree = etree.fromstring(value, parser)\n    return tree\n"),
    (7, _BODY * 2, _BODY * 2),
    (8, _BODY + "    return eval(value)\n", _BODY + "    return eval(value), check(value), other(value)\n"),
    (9, "", "def f(): pass"),
    (10, _BODY + "x = 1\n" * 400, _BODY + "y = 2\n" * 20),
    (11, "nothing to see here " * 8, _BODY + "    return 1\n"),
    (12, _BODY + "    a = zeta(alpha)\n", "class Other:\n    " + " ".join(f"w{i}" for i in range(60)) + "\n"),
]
