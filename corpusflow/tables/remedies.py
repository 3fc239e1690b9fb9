"""Rule id -> remediation key.  Fixed values, matched in this order."""
from __future__ import annotations

EXPLICIT = {
    "sca.vulnerable-dependency": "dependency",
    "infra.ado-connection": "hardcoded-connection",
    "infra.jdbc-connection": "hardcoded-connection",
    "infra.oracle-tns": "hardcoded-connection",
    "infra.smtp-ldap-bind": "hardcoded-connection",
    "infra.default-test-account": "default-account",
    "infra.developer-local-path": "dev-path",
    "infra.private-ip": "internal-info",
    "infra.admin-path-hardcoded": "internal-info",
    "infra.command-execution-api": "command-injection",
    "infra.webview-dangerous-setting": "webview",
    "hygiene.debug-code-left": "debug",
    "hygiene.debug-enabled": "debug",
    "hygiene.kr-leftover-comment": "comment-leak",
    "web.document-write": "xss",
    "web.inner-html-assign": "xss",
    "web.react-dangerous-html": "xss",
    "web.insecure-cookie-flags": "cookie-flags",
    "web.token-in-web-storage": "token-storage",
}

KEYS = ("sqli", "command-injection", "xss", "path-traversal", "ssrf", "code-injection", "file-inclusion",
        "open-redirect", "secret", "pii", "tls", "crypto", "deserialization", "ldap-injection",
        "xpath-injection", "buffer-overflow", "format-string", "library-injection", "intent-redirect",
        "webview", "token-storage", "cookie-flags", "debug", "comment-leak", "hardcoded-connection",
        "default-account", "dev-path", "dependency", "internal-info")

#: What an observation has to show for each key.
ORACLE = {"command-injection": "time_delay", "sqli": "time_delay", "ssrf": "oast_callback",
          "xss": "reflected_marker", "path-traversal": "file_content", "file-inclusion": "file_content",
          "open-redirect": "redirect_location"}
DELAY_MS = 5000
BLOCKED = ("REQUIRES_AUTH", "UNSAFE_ENVIRONMENT", "VALIDATION_BLOCKED", "REQUIRES_USER_ACTION")

#: Request accessor -> (HTTP method, where the value sits).
ACCESSOR = {
    "Query": ("GET", "query"), "GetQuery": ("GET", "query"), "DefaultQuery": ("GET", "query"),
    "PostForm": ("POST", "form"), "DefaultPostForm": ("POST", "form"), "Param": ("GET", "path"),
    "GetHeader": ("GET", "header"), "Cookie": ("GET", "cookie"), "FormValue": ("GET", "query"),
    "PostFormValue": ("POST", "form"), "Body": ("POST", "body"), "GetRawData": ("POST", "body"),
    "query": ("GET", "query"), "body": ("POST", "body"), "params": ("GET", "path"),
    "getParameter": ("GET", "query"), "getHeader": ("GET", "header"),
    "args": ("GET", "query"), "form": ("POST", "form"),
}
