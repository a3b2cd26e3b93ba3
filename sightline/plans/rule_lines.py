"""For each built-in rule, in order, a line of its language that it fits."""

#: Lines by rule group, in the order of the rules.
POSITIVE = {
    "python": ["password = 'abcd'", "secret = 'abcdefgh1'", "api_key = 'abcdefgh1'", "token = 'abcdefghijklmnop'", "execute('SELECT a' + x", "cursor.execute('a' % (x", "'{}'.format(x) + 'SELECT'", "subprocess.run(c, shell=True)", "os.system(c)", "eval(x)", "exec(x)", "pickle.loads(x)", "yaml.load(x)", "import ftplib", "requests.get('http://a')", "urlopen('http://a')", "md5(x)", "sha1(x)", "random.choice(x)", "assert user.is_admin", "shutil.rmtree(x)"],
    "java": ["Statement s = c", 'q.executeQuery("a" + b)', 's.execute("a" + b)', '"SELECT a" + b', "Runtime.getRuntime().exec(c)", "ProcessBuilder(a).command(x + y)", "getParameter(\"a\"); out.println(x)", "w.println(request.getParameter(x))", 'password = "abc"', "@GetMapping", "new ObjectInputStream(x)", 'MessageDigest.getInstance("MD5")', 'getInstance("DES")', "cipher.doFinal(x.getBytes())", "Math.random()", "new Random()", "System.getenv(x) + y", "URLClassLoader l"],
    "cpp": ["gets(b)", "strcpy(a, b)", "strcat(a, b)", "sprintf(a, b)", "vsprintf(a, b)", 'scanf("%s", b)', "strncpy(a, b, sizeof(a))", "memcpy(a, b, sizeof(a))", "f(malloc(4));", "new Foo;", "delete p; p->x", "free(p);", "char b[10];", "strlen(argv[1])", "atoi(x)", "system(c)", "strcmp(a, password)", "alloc(a + b)", "atoi(argv[1])"],
    "php": ["$_GET['a'] echo", "echo $_REQUEST", "echo 'a' . $_GET['b']", 'mysql_query("a $b', "SELECT a . $b", '$pdo->query($q)', "shell_exec($c)", "include($_GET['a'])", "curl_exec($c)", "move_uploaded_file($a", "$_FILES['a']['name", "password_verify(a)", "md5($password)", "unserialize($_COOKIE", "session_start(); $_SESSION['user'] = '1", "referer == x", "$_POST['user_id", "<form method=POST>", '$password = "abc"'],
    "js": ["a.innerHTML = location.hash", "document.write(location)", "x.html(document.URL)", "eval(data)", "eval(x)", "new Function(location)", "window.open(u)", "w.postMessage(a, *)", "addEventListener('message', data", "localStorage.setItem('token')", "http://a", "Math.random() + token"],
    "html": ["<script>eval(", "<a href='javascript:x'>", "<iframe src='javascript:x'>", "onerror = x", "<form>", "<input type='password'>"],
    "css": ["expression(x)", "url(javascript:x)", "behavior: url"],
    "go": ["exec.Command('sh'", "os/exec.xCommand(a...", 'password: "abcdef"', "crypto/md5", "x http://a # c", "tls.Config{InsecureSkipVerify: true", "fmt.Sprintf('SELECT", "template.HTML(x)"],
    "ruby": ["eval(x)", "system(x)", "password = 'abcdef'", "find_by_sql(x)", "render text => x", "verify_mode = OpenSSL::SSL::VERIFY_NONE", "Digest::MD5", "YAML.load(x)"],
    "rust": ["unsafe {", 'std::process::Command::new("sh")', 'password = "abcdef"', "x.unwrap()", "md5::x"],
    "csharp": ['Process.Start("cmd")', "new SqlCommand(a + b)", 'password = "abcdef"', "MD5.Create", "Response.Write(Request[", "WebRequest.Create(u)", "Random r = new Random()", "ValidateRequest = false"],
    "kotlin": ["Runtime.getRuntime().exec(x)", 'password = "abcdef"', "rawQuery(x)", "exported = true", 'MessageDigest.getInstance("MD5")', "WebView.setJavaScriptEnabled(true"],
    "swift": ['password = "abcdef"', "Process()", "allowsArbitraryLoads", "Insecure.MD5", "evaluateJavaScript(x"],
    "shell": ["eval $x", "curl a | sh", "password='abcd'", "rm -rf $x", "chmod 777 a", "nc -l", "sshpass"],
    "sql": ["GRANT ALL PRIVILEGES", "CREATE USER a WITH PASSWORD = 'abc'", "IDENTIFIED BY 'abc'", "sp_executesql @sql", "sslmode = disable"],
}
