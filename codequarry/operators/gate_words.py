"""Word lists of the gates of each family: fixed values, in their natural order."""
# fmt: off
# Words of definitions
DESER_FUNCTIONS = (
    "def ", "func ", "fn ", "function ", "async function", "public ", "private ", "protected ", "static ", "void ", "async ", "const ", "let ",
    "var ", "fun ", "<?php", "class ", "interface ", "router.", "app.get(", " do\n", " do |",
)
CRYPTO_FUNCTIONS = (
    "def ", "func ", "function ", "public ", "private ", "protected ", "static ", "async function", "void ", "class ", "module.exports", "fn ", "fun ",
    "sub ", "object ", "interface ",
)
SQL_FUNCTIONS = (
    "def ", "func ", "fn ", "function ", "async function", "public ", "private ", "protected ", "internal ", "override ", "static ", "void ", "async ",
    "const ", "let ", "var ", "module.exports", "exports.", "<?php", "fun ", "object ", "class ", "interface ", "router.", "app.get(", "app.post(",
    "app.put(", "http.HandleFunc(", "Route::", "@app.route", "@router.", " do\n", " do |", "post '", "get '", "post \"", "get \"", "@GetMapping",
    "@PostMapping", "@RequestMapping",
)
XSS_FUNCTIONS = SQL_FUNCTIONS
XML_FUNCTIONS = (
    "def ", "func ", "fn ", "public ", "private ", "protected ", "internal ", "override ", "static ", "void ", "async ", "function ", "async function",
    "const ", "let ", "var ", "module.exports", "exports.", "<?php", "fun ", "object ", "class ", "interface ", "sub ", "Route(", "router.", "app.get(",
    "app.post(", "app.put(", "http.HandleFunc(", "http.Handle(", "Route::", "@app.route", "@router.", " do\n", " do |", "post '", "get '", "post \"",
    "get \"",
)
PATH_FUNCTIONS = (
    "def ", "func ", "fn ", "public ", "private ", "protected ", "internal ", "override ", "static ", "void ", "async ", "function ",
    "async function", "const ", "let ", "var ", "module.exports", "exports.", "function ", "<?php", "def ", "do |", "fun ", "object ", "class ",
    "interface ", "sub ", "Route(", "router.", "app.get(", "app.post(", "app.put(", "http.HandleFunc(", "http.Handle(", "Route::", "@app.route",
    "@router.",
)

# Words that show the weakness
DESER_INDICATORS = (
    "unserialize(", "$_GET[", "$_POST[", "$_COOKIE[", "$_REQUEST[", "pickle.loads(", "pickle.load(", "cPickle.loads(", "yaml.load(", "yaml.load(data",
    "yaml.load(content", "ObjectInputStream", "readObject()", "new ObjectInputStream(", "unserialize(", "node-serialize", "require('serialize'",
    'require("serialize"', "gob.Decode(", "gob.NewDecoder(", "gob.Register(", "BinaryFormatter", "NetDataContractSerializer", ".Deserialize(",
    "LosFormatter", "SoapFormatter", "Marshal.load(", "Marshal.restore(", "yaml.load(", "YAML.load(", "Psych.load(", "deserialize", "Deserialize",
    "unserialize", "unmarshal", "decode(", "Decode(", "fromBytes(", "from_bytes(", "readObject", "loadObject", "fromString(",
)
PATH_INDICATORS = (
    "../", '..\\', "%2e%2e", "%252e", '\\x00', "%00", "os.path.join", "open(", "send_file", "render_template", "send_from_directory", "safe_join",
    "readFile", "createReadStream", "fs.readFileSync", "fs.readFile(", "fs.createWriteStream", "fs.writeFile(", "path.join(", "res.sendFile",
    "path.resolve(", "fs.open(", "file_get_contents", "fopen(", "include(", "include_once(", "require_once(", "readfile(", "file(", "new File(",
    "FileInputStream", "new FileReader(", "Files.readAllBytes", "Files.newInputStream", "Paths.get(", "Path.of(", "getResourceAsStream",
    "new FileOutputStream(", "Files.readString(", "Files.copy(", "File.ReadAllBytes", "File.OpenRead", "File.ReadAllText(", "Path.Combine(",
    "new FileStream(", "File.Open(", "System.IO.File", "File.ReadAllLines(", "os.Open(", "os.ReadFile(", "ioutil.ReadFile(", "filepath.Join(",
    "http.ServeFile(", "os.Stat(", "io.ReadAll(", "os.Create(", "File.read(", "File.open(", "File.binread(", "send_file", "render file:", "IO.read(",
    "File(", "readBytes(", "inputStream(", "readText(", "extractall", "zipfile.ZipFile", "tarfile.open", "ZipInputStream(",
    "ZipFile.ExtractToDirectory", "archive/zip", "serve_file", "download_file", "getFile", "loadFile", "readConfig", "loadTemplate", "serveContent",
)
SQL_INDICATORS = (
    "SELECT ", "INSERT ", "UPDATE ", "DELETE ", "WHERE ", "select ", "insert ", "update ", "delete ", "where ", "FROM ", "JOIN ", "UNION ",
    "ORDER BY", "GROUP BY", "execute(", "query(", "Query(", "Execute(", "cursor.execute(", "db.query(", "pool.query(", "db.Query(",
    "connection.query(", "client.query(", "pdo->query(", "mysqli_query(", "$pdo->query(", "DB::select(", "DB::statement(", "DB::unprepared(",
    "session.execute(", "engine.execute(", "db.execute(", "conn.execute(", "raw(", ".raw(", "createNativeQuery(", "nativeQuery(", "db.Exec(",
    "db.QueryRow(", "executeQuery(", "executeUpdate(", "createStatement(", "SqlCommand(", "ExecuteReader(", "ExecuteNonQuery(", "ExecuteScalar(",
    "ExecuteAsync(", "execute(", "ActiveRecord::Base.connection.execute(", "find_by_sql(", "connection.execute(", "transaction {", "exec(",
    'f"SELECT', 'f"INSERT', 'f"UPDATE', 'f"DELETE', "f'SELECT", "f'INSERT", "f'UPDATE", "f'DELETE", '"SELECT', '"INSERT', '"UPDATE', '"DELETE',
    "'SELECT", "'INSERT", "'UPDATE", "'DELETE", '+ " WHERE', "+ ' WHERE", 'WHERE " +', "WHERE ' +", '" + id', '" + name', '" + user', '" + param',
    '" + val', "' + id", "' + name", "' + user", "' + param", "#{id}", "#{name}", "#{user}", "#{param}", "#{query}", "${id}", "${name}", "${user}",
    "${param}", 'LIKE \'%" +', "LIKE '%", 'ORDER BY " +', "ORDER BY ' +", 'IN (" +', "IN (' +", "sql =", "sql=", "query =", "query=", "SQL =", "SQL=",
    "sqlQuery", "sqlString", "queryString", "queryStr", "sqlStr", 'sql = "SELECT', "sql = 'SELECT", 'query = "SELECT', "query = 'SELECT",
    "sql.append(", "sb.append(", "StringBuilder", "string.Format(", "String.Format(", '$"SELECT', "sprintf(", "fmt.Sprintf(", "interpolat",
    'format("SELECT', "format('SELECT", ".raw(", "db.raw(", "knex.raw(", "sequelize.query(", "Sequelize.query(", "sqlalchemy.text(", 'text("SELECT',
)
XML_INDICATORS = (
    "xml", "XML", "etree", "ElementTree", "parse(", "fromstring(", "parseString(", "DocumentBuilder", "SAXParser", "SAXParserFactory", "XmlDocument",
    "XDocument", "XmlReader", "XmlTextReader", "SimpleXML", "simplexml", "DOMDocument", "DOMParser", "Nokogiri", "xml2js", "fast-xml-parser", "fxp",
    "xml.NewDecoder", "encoding/xml", "JAXB", "Unmarshal", "unmarshal", "Marshal", "XMLDecoder", "XMLEncoder", "DOCTYPE", "ENTITY", "SYSTEM",
    "!ENTITY", "<!DOCTYPE", "<!ENTITY", "XPath", "xpath", "//user", "//", "selectNodes", "selectSingleNode", "evaluate(", "xmlXPathEval",
    'compile("//', "compile('//", "SOAP", "soap", "Envelope", "envelope", "wsdl", "WSDL", "SOAPAction", "soapenv", "zeep", "suds", "SoapClient",
    "SoapServer", "XSLT", "xslt", "transform(", "Transformer", "XslCompiledTransform", "xsltproc", "XSLTProcessor", "xsl:stylesheet", "xsl:template",
    "<svg", ".svg", "image/svg", "svg+xml", "xinclude(", "XInclude", "xi:include", "process_xincludes", "xinclude=True", "docx", "xlsx", "odt",
    "ZipFile", "zipfile", "word/document.xml", "xl/workbook.xml", "tostring(", "serialize(", "toString(", "XMLOutputter", "render_to_string",
    "buildString(", "xmlstring", "<user>", "<item>", "<name>", "<query>", "<request>", "<root>",
)
XSS_INPUT = (
    "request.args", "request.form", "request.GET", "request.POST", "request.json", "request.data", "request.values", "params[", "request.params",
    "request.query", "$_GET[", "$_POST[", "$_REQUEST[", "$_COOKIE[", "$request->", "Input::", "request()->", "req.query", "req.params", "req.body",
    "req.headers", "searchParams", "URLSearchParams", "params.get(", "request.getParameter(", "@RequestParam", "@PathVariable", "@RequestBody",
    "r.URL.Query()", "r.FormValue(", "c.Query(", "c.Param(", "c.PostForm(", "ctx.QueryParam(", "Request.Query[", "Request.Form[",
    "Request.QueryString[", "[FromQuery]", "[FromBody]", "params[:", 'params["', "request.params", "params.fetch", "call.parameters[",
    "call.request.queryParameters[", "call.receiveText(", "call.receive(", "user_input", "userInput", "user_data", "userData", "comment", "message",
    "username", "user_name", "search", "term", "keyword", "content", "description", "title", "query", "name", "text", "value", "data", "payload",
    "input", "param", "field", "msg", "post", "review", "bio", "profile", "location.search", "location.hash", "location.href", "document.URL",
    "document.referrer", "window.name", "localStorage.", "sessionStorage.", "event.data", "e.data", "message.data", "URLSearchParams(window.location",
)
XSS_OUTPUT = (
    "innerHTML", "outerHTML", "insertAdjacentHTML", "document.write", "render_template(", "render(", "HttpResponse(", 'return f"<', "return f'<",
    'return "<', "return '<", "return `<", "Response(", "make_response(", "echo ", "echo(", "print ", "print(", "print_r(", "<?=", "printf(",
    "res.send(", "res.end(", "res.write(", "res.json(", "reply.send(", "reply.html(", "out.print(", "out.println(", "response.getWriter(",
    "writer.print(", "ResponseEntity", "ok().body(", "@Html.Raw(", "Html.Raw(", "Response.Write(", "return Content(", ".html_safe", "render html:",
    "render :html", "render inline:", "fmt.Fprintf(w", "w.Write(", "c.String(", "c.HTML(", "ctx.HTML(", "ctx.String(", 'f"<', "f'<", "`<", "${", "#{",
    ".format(", "| safe", "|safe", "| raw", "|raw", "Markup(", "mark_safe(", "dangerouslySetInnerHTML", "v-html=", "bypassSecurityTrust", '"<p>',
    "'<p>", '"<div>', "'<div>", '+ "<', "+ '<", "htmlContent", "htmlString", "<script>", "<img ",
)

# Calls that must go or be guarded
DESER_UNSAFE = (
    "pickle.loads(", "pickle.load(", "cPickle.loads(", "yaml.load(", "YAML.load(", "unserialize(", "Marshal.load(", "BinaryFormatter",
    "NetDataContractSerializer", "gob.NewDecoder(", "ObjectInputStream", "readObject()",
)

# Words of lines that render
XSS_RENDER = (
    "innerHTML", "outerHTML", "document.write", "insertAdjacentHTML", "render_template(", "render(", "render_to_string(", "res.send(", "res.end(",
    "res.json(", "Response(", "HttpResponse(", "echo ", "echo(", "print(", "printf(", "print_r(", 'return f"<', "return f'<", 'return "<',
    "return '<", "return `<", "write(", "out.print", "dangerouslySetInnerHTML", ".html_safe", "| safe", "|safe", "| raw", "|raw", "Markup(",
    "mark_safe(", "fmt.Fprintf(w,", "w.Write(", "th:text", "th:utext", "@Html.Raw(", "@Html.", "v-html=", "[innerHTML]=", "bypassSecurityTrust", "${",
    "#{", 'f"<', "f'<", "`<", "render html:",
)

# Words that show a fix
DESER_MITIGATION = (
    "json.loads(", "json_decode(", "JSON.parse(", "json.Unmarshal(", "JsonSerializer.Deserialize", "System.Text.Json", "json.safe_load(",
    "JSON.parse(", "json_decode(", "base64_decode(", "hash_equals(", "yaml.safe_load(", "json.loads(", "hmac.compare_digest(", "hashlib.sha",
    "secrets.compare_digest(", "ObjectInputFilter", "createFilter(", "allowClasses(", "JsonMapper", "ObjectMapper", "XmlMapper", "readValue(",
    "readTree(", "JsonSerializer", "Newtonsoft.Json", "JsonConvert", "System.Text.Json", "DataContractJsonSerializer", "XmlSerializer", "protobuf",
    "json.Unmarshal(", "json.NewDecoder(", "encoding/json", "proto.Unmarshal(", "xml.Unmarshal(", "JSON.parse(", "json.parse(", "Psych.safe_load(",
    "YAML.safe_load(", "yaml.safe_load(", "JSON.parse(", "safeDeserialize(", "validateSchema(", "hmac", "HMAC", "verify(", "signature", "digest(",
    "compare_digest", "hash_equals", "allowlist", "whitelist", "ALLOWED_", "validate(", "raise", "throw", "reject(", "abort(", "return null",
    "return nil", "return false", "return False", "400", "403", "HttpStatus.BAD_REQUEST",
)
PATH_MITIGATION = (
    "realpath", "abspath", "safe_join", "send_from_directory", "secure_filename", "normpath", "commonpath", "resolve(", "basename(", "basename ",
    "allowlist", "whitelist", "ALLOWED_", "allowed_", "sanitize", "sanitise", "sanitized", "startswith(base", "startswith(upload", "startswith(log",
    "startswith(config", "startswith(template", "startswith(dest", "startswith(target", "startswith(extract", "startswith(root", "startsWith(base",
    "startsWith(upload", "startsWith(log", "startsWith(config", "startsWith(template", "startsWith(dest", "startsWith(target", "startsWith(extract",
    "startsWith(root", "getCanonicalPath", "toRealPath", "normalize()", ".normalize()", "isSymbolicLink", "NOFOLLOW_LINKS", "LinkOption",
    "startsWith(allowed", "startsWith(base", "filepath.Abs(", "filepath.Clean(", "filepath.EvalSymlinks(", "strings.HasPrefix(", "path.Clean(",
    "Path.GetFullPath(", "Path.GetFileName(", "GetFullPath(", "StartsWith(basePath", "StartsWith(base", "Regex.IsMatch(", "Path.GetExtension(",
    "path.resolve(", "path.basename(", "path.normalize(", ".startsWith(uploadDir", ".startsWith(baseDir", ".startsWith(rootDir", ".startsWith(logDir",
    ".startsWith(configDir", ".startsWith(templatesDir", "realpath(", "basename(", "pathinfo(", "strpos($", "str_starts_with(", "preg_match(",
    "in_array(", "array_key_exists(", "File.realpath(", "File.basename(", "Pathname.new(", ".start_with?(", ".include?(allowed", "expand_path(",
    "canonicalPath", "absolutePath", ".startsWith(base", "safe_extract", "canonical", "zipEntry", "targetDir", "unquote", "URLDecoder",
    "Uri.UnescapeDataString", "url.QueryUnescape", "decodeURIComponent", "re.fullmatch", "re.match(r", "re.search(r", "fullmatch(", "Pattern.compile",
    "Regex(",
)
SQL_MITIGATION = (
    "prepare(", "prepareStatement(", "PreparedStatement", "cursor.execute(", "cursor.executemany(", "%s", "%d", "%i", "%(", "?", "$1", "$2", "$3",
    ":name", ":param", ":id", ":value", ":query", "@param", "@id", "@value", "@name", "params=", "params=[", "params=(", "values=(", "bind_param(",
    "bindParam(", "bindValue(", "execute([", "execute(query,", "execute(sql,", "text(", "db.execute(text(", "sqlalchemy.text(", ".filter(",
    ".filter_by(", ".where(", "session.query(", "db.session.query(", "objects.filter(", "objects.get(", "objects.exclude(", "annotate(", "aggregate(",
    ".values(", ".only(", "psycopg2", 'cursor.execute("%s"', "mogrify(", "setString(", "setInt(", "setLong(", "setDate(", "setParameter(",
    "setParam(", "createQuery(", "createNativeQuery(", "namedParameterJdbcTemplate", "NamedParameterJdbcTemplate", "MapSqlParameterSource",
    "BeanPropertySqlParameterSource", '@Query("', "@Param(", "JdbcTemplate", "entityManager.createQuery(", "db.query(query, [", "pool.query(query, [",
    "pool.query(sql, [", "client.query(sql, [", "connection.query(query, [", "connection.execute(", "createQueryBuilder(", ".andWhere(",
    ".setParameter(", "getRepository(", "typeorm", "prepare(", "->prepare(", "pdo->prepare(", "bindParam(", "bindValue(", "execute(array(",
    "whereIn(", "where('", "->where(", "->find(", "Model::where(", "DB::select(", "DB::table(", "->whereRaw(", "orWhere(", "->get()",
    "db.Query(query, ", "db.QueryRow(query, ", "db.Exec(query, ", "rows, err := db.Query(", "pgx.Connect(", "pgxpool.", "sq.Select(",
    "sqlx.NamedExec(", ".NamedQuery(", "AddWithValue(", "Parameters.Add(", "SqlParameter(", "DbParameter(", ".FromSqlRaw(", ".FromSqlInterpolated(",
    "DapperExtensions", ".Query<", "commandText", "CommandType.Text", 'where("', "where(id:", "where(status:", ".find(", ".find_by(", "sanitize_sql(",
    'where(["', "connection.execute(", "Sequel.lit(", ".where(Sequel.lit(", "ALLOWED_COLUMNS", "ALLOWED_SORT", "allowed_cols", "allowed_columns",
    "valid_columns", "VALID_COLUMNS", "whitelist_columns", "column_whitelist", "in ALLOWED", "in allowed", "in COLUMNS", "raise", "throw", "abort(",
    "return nil", "return null", "return false", "return False", "int(", "Integer.parseInt(", "int.Parse(", "intval(", "isdigit()", ".isdigit()",
    "isnumeric()", ".isnumeric()", "re.match(", "re.fullmatch(", "Pattern.compile(", "Regex.IsMatch(", "preg_match(", "ValueError(",
    "IllegalArgumentException(", "SecurityException(", "400", "403", "HttpStatus.BAD_REQUEST",
)
XSS_MITIGATION = (
    "html.escape(", "cgi.escape(", "escape(", "markupsafe", "Markup(", "escape_html(", "bleach.clean(", "bleach.linkify(", "jinja2.escape(",
    "markupsafe.escape(", "htmlspecialchars(", "htmlentities(", "strip_tags(", "ENT_QUOTES", "ENT_HTML5", "filter_var(", "escapeHtml(", "escape-html",
    "escape(str", "DOMPurify", "DOMPurify.sanitize(", "sanitizeHtml(", "xss(", "xss-filters", "textContent", "createTextNode(", "innerText",
    "encodeURIComponent(", "encodeURI(", "require('escape-html')", 'require("escape-html")', "require('he')", 'require("he")', "he.encode(",
    "validator.escape(", "xssFilters.", "StringEscapeUtils.escapeHtml4(", "StringEscapeUtils.escapeHtml(", "HtmlUtils.htmlEscape(",
    "HtmlEncoder.encode(", "ESAPI.encoder().encodeForHTML(", "Encode.forHtml(", "Jsoup.clean(", "Whitelist.", "SafeList.", "escapeHtml4(",
    "escapeHtml(", "HtmlEscape(", "HtmlEncoder.Default.Encode(", "HttpUtility.HtmlEncode(", "AntiXssEncoder.HtmlEncode(", "WebUtility.HtmlEncode(",
    "HtmlEncode(", "AntiXss.HtmlEncode(", "Encoder.HtmlEncode(", "html_escape(", "h(", "CGI.escapeHTML(", "ERB::Util.html_escape(", "sanitize(",
    "ActionView::Base.full_sanitizer", "Rack::Utils.escape_html(", "escape_html(", "html.EscapeString(", "template.HTMLEscapeString(",
    "html/template", "template.HTML(", "url.QueryEscape(", "text/template", "template.JSEscapeString(", "HtmlUtils.htmlEscape(",
    "StringEscapeUtils.escapeHtml4(", "Encode.forHtml(", "escapeHtml(", "autoescape", "auto_escape", "{{ ", "}}", "{% autoescape", "th:text=",
    "th:utext", "@Html.Encode(", "@Html.Raw(", "c:out", "fn:escapeXml(", "Content-Security-Policy", "content_security_policy", "X-XSS-Protection",
    "X-Content-Type-Options", "textContent", "createTextNode", "innerText", "setAttribute(", "setAttributeNode(", "DOMPurify.sanitize(",
    "sanitize(content", "sanitize(data", "sanitize(user", "purify.sanitize(", "raise", "throw", "abort(", "return nil", "return null", "400", "403",
    "HttpStatus.BAD_REQUEST", "allowlist", "whitelist", "ALLOWED_", "re.match(", "re.fullmatch(", "re.sub(", "Pattern.compile(", "Regex.IsMatch(",
    "preg_match(",
)

# Words that may show a fix
DESER_BROAD = (
    "safe", "Safe", "SAFE", "secure", "Secure", "validate", "Validate", "verify", "Verify", "allowlist", "whitelist", "ALLOWED", "allowed", "json",
    "JSON", "protobuf", "proto", "hmac", "HMAC", "signature", "digest", "raise", "throw", "reject", "abort", "return null", "return nil",
    "return false", "400", "403", "filter", "Filter",
)
SQL_BROAD = (
    "param", "Param", "PARAM", "bind", "Bind", "prepared", "Prepared", "parameterized", "Parameterized", "placeholder", "sanitize", "Sanitize",
    "escape", "Escape", "validate", "Validate", "allowlist", "whitelist", "ALLOWED", "allowed", "valid_", "isValid", "is_valid", "raise", "throw",
    "abort(", "return null", "return nil", "return false", "return False", "filter(", "Filter(", "where(", "Where(", "query(", "Query(", "execute(",
    "Execute(", "400", "403", "BadRequest", "Forbidden", "int(", "Integer", "intval(", "isdigit", "re.match", "Pattern", "Regex", "preg_match", "ORM",
    "orm", "repository", "Repository",
)
# those that hold no word of XML_BROAD, which decides before them
XML_MITIGATION = (
    "defusedxml", "defused_xml", "from defusedxml", "import defusedxml", "forbid_dtd", "forbid_entities", "forbid_external", "no_network",
    "resolve_entities=False", "load_dtd=False", "XMLParser(", "no_network=True", "XMLParser(resolve_entities", "XMLParser(no_network",
    "etree.XMLParser(", "lxml.etree", "markupsafe", "setFeature(", "DISALLOW_DOCTYPE_DECL", "setExpandEntityReferences(false", "setValidating(false",
    "http://apache.org/xml/features", "external-general-entities", "external-parameter-entities", "disallow-doctype-decl", "setXIncludeAware(false",
    "newDocumentBuilder()", "DocumentBuilderFactory", "XMLInputFactory", "IS_SUPPORTING_EXTERNAL_ENTITIES", "SUPPORT_DTD",
    "setProperty(XMLInputFactory", "IS_NAMESPACE_AWARE", "IS_VALIDATING", "XPathVariableResolver", "setXPathVariableResolver", "setVariable(",
    "XPathConstants", "TransformerFactory.newInstance(", "setErrorListener", "DtdProcessing.Ignore", "XmlReaderSettings", "XmlResolver = null",
    "XmlUrlResolver", "new XmlReaderSettings", "settings.DtdProcessing", "LIBXML_NONET", "LIBXML_DTDLOAD", "LIBXML_NOENT",
    "libxml_set_external_entity_loader", "LIBXML_NONET | LIBXML_DTDLOAD", "htmlspecialchars(", "htmlentities(", "addslashes(", "filter_var(",
    "processEntities: false", "allowBooleanAttributes", "explicitArray", "ignoreAttrs", "parseXml", "xmlbuilder", "require('xmlbuilder",
    'require("xmlbuilder', "xml.NewDecoder(", "d.Entity", "http.MaxBytesReader(", "io.LimitReader(", "golang.org/x/net/html",
    "Nokogiri::XML::ParseOptions::NONET", "Nokogiri::XML::ParseOptions::NOBLANKS", "parse_options:", "NONET", "NOENT",
    "Nokogiri::XML(body, nil, nil,", "options.nononet", "options.nonet", "Nokogiri::XML::ParseOptions::DEFAULT_XML", "factory.setFeature(",
    "dbf.setFeature(", "XMLConstants.ACCESS_EXTERNAL_DTD", "setProperty(XMLConstants", "xpath.evaluate(", "XPathVariable", "param_", "bind_variable",
    "bindVariable", "Schema(", "XmlSchema", ".xsd", "xmlschema", "SchemaFactory", "schema.newValidator", "re.match(", "re.fullmatch(", "re.sub(",
    "Regex(", "enableExtensions = false", "setExtensionElementPrefixes", "no_extensions", "spf.setFeature(", "builder.setFeature(",
    "parser.setFeature(", 'setFeature("http://xml.org', 'setFeature("http://javax.xml', "ACCESS_EXTERNAL_SCHEMA", "factory.setAttribute(",
    "dbf.setAttribute(", "newSAXParser()", "SAXParserFactory.newInstance(", "defusedxml.ElementTree", "defusedxml.minidom",
    "defusedxml.expatbuilder", "defusedxml.sax", "defusedxml.pulldom", "from defusedxml import", "etree.XMLParser(no_network",
    "etree.XMLParser(resolve_entities", "forbid_dtd=True", "settings.XmlResolver = null", "new XmlReaderSettings()", "XmlReader.Create(",
    "settings.MaxCharactersFromEntities", "XmlDocument.XmlResolver = null", "entities: false", "allowEntities", "entityExpansion", "parseOptions",
    "strict: true", "LIBXML_NONET | LIBXML_DTDATTR", "strip_tags(", "preg_replace(", "charsetReader", "charset.NewReaderLabel", "xml.CopyToken",
    "xml.Token", "Nokogiri::XML(xml_string, nil, nil,", "ParseOptions::NONET", "ParseOptions::DEFAULT_XML", "Nokogiri::XML.parse(",
    ".parse(doc, nil, nil,", "maxDepth", "raise", "throw", "Exception(", "Error(", "return nil", "return null", "return false", "abort(", "halt(",
)
XML_BROAD = (
    "disable", "Disable", "DISABLE", "prohibit", "Prohibit", "PROHIBIT", "restrict", "Restrict", "prevent", "secure", "Secure", "SECURE", "safe_",
    "Safe", "_safe", "validate", "Validate", "VALIDATE", "verify", "Verify", "check_", "is_valid", "isValid", "is_safe", "encode", "Encode", "ENCODE",
    "escape", "Escape", "ESCAPE", "sanitize", "Sanitize", "clean_", "raise ValueError", "raise SecurityError", "raise Exception", "throw new",
    "throw new Security", "throw new Illegal", "return Response(status=400", "return Response(status=403", "response.status(400",
    "response.status(403", "res.status(400", "res.status(403", "res.status(422", "abort(400", "abort(403", "abort(422", "HttpStatus.BAD_REQUEST",
    "HttpStatus.FORBIDDEN", "StatusCode.BadRequest", "StatusCode.Forbidden", "http.StatusBadRequest", "http.StatusForbidden", "render json:.*error",
    "render json:.*invalid", "allowed_", "ALLOWED_", "allowlist", "whitelist", "in ALLOWED", "in allowed", "in valid_", "compile(", "compiled",
    "prepared", "parameterize", "bind(", "setParam", "addParam", "max_", "MAX_", "limit", "LIMIT", "depth", "DEPTH", "size_limit",
)
XSS_BROAD = (
    "escape", "Escape", "ESCAPE", "encode", "Encode", "ENCODE", "sanitize", "Sanitize", "SANITIZE", "purify", "Purify", "htmlspecial", "htmlentities",
    "htmlencode", "HtmlEncode", "textContent", "createTextNode", "innerText", "safe", "Safe", "clean", "Clean", "strip", "Strip", "validate",
    "Validate", "allowlist", "whitelist", "ALLOWED", "raise", "throw", "abort(", "return null", "return nil", "return false", "return False", "400",
    "403", "BadRequest", "Forbidden", "CSP", "csp", "nonce", "policy", "re.match", "Pattern", "Regex", "preg_match", "filter", "Filter",
)
