"""Checklists: item -> CWE list.  Fixed values; items keep the order of their documents.

Each row is (code, item, group, CWE numbers).  A checklist is the set of items an
assessment must answer for, so items no rule can see are listed too.
"""
from __future__ import annotations

_INPUT = "Input data validation and representation"
_SECURITY = "Security features"
_TIME = "Time and state"
_ERROR = "Error handling"
_CODE = "Code error"
_CAPSULE = "Encapsulation"
_API = "API abuse"
_MOBILE = "Mobile platform"

# ---- fixed values ------------------------------------------------------------------------

MOIS = [
    ("sql-injection", "SQL injection", _INPUT, [89]),
    ("code-injection", "Code injection", _INPUT, [94, 95, 96]),
    ("path-resource-injection", "Path manipulation and resource injection", _INPUT, [22, 23, 73, 99, 98]),
    ("xss", "Cross-site scripting", _INPUT, [79, 80]),
    ("os-command-injection", "OS command injection", _INPUT, [78, 77]),
    ("file-upload", "Unrestricted file upload", _INPUT, [434]),
    ("open-redirect", "Open redirect", _INPUT, [601]),
    ("xxe", "XML external entity (XXE)", _INPUT, [611]),
    ("xml-injection", "XML injection", _INPUT, [91, 643, 652]),
    ("ldap-injection", "LDAP injection", _INPUT, [90]),
    ("csrf", "Cross-site request forgery", _INPUT, [352]),
    ("ssrf", "Server-side request forgery", _INPUT, [918]),
    ("http-response-splitting", "HTTP response splitting", _INPUT, [113]),
    ("integer-overflow", "Integer overflow", _INPUT, [190, 191]),
    ("untrusted-security-decision", "Untrusted input in a security decision", _INPUT, [807, 350]),
    ("buffer-overflow", "Memory buffer overflow", _INPUT, [119, 120, 125, 787, 121, 122]),
    ("format-string", "Format string injection", _INPUT, [134]),
    ("missing-authentication", "Critical function without authentication", _SECURITY, [306]),
    ("improper-authorization", "Improper authorization", _SECURITY, [285, 862, 863]),
    ("wrong-permission", "Incorrect permission assignment for a critical resource", _SECURITY, [732]),
    ("weak-crypto-algorithm", "Use of a broken cryptographic algorithm", _SECURITY, [327, 328]),
    ("unencrypted-sensitive-data", "Sensitive data without encryption", _SECURITY, [311, 312, 319, 359, 200]),
    ("hardcoded-secret", "Hard-coded credentials", _SECURITY, [798, 259, 321, 547]),
    ("short-key-length", "Inadequate encryption key length", _SECURITY, [326]),
    ("weak-random", "Use of insufficiently random values", _SECURITY, [330, 338, 337]),
    ("weak-password", "Weak password requirements", _SECURITY, [521, 522]),
    ("signature-verification", "Improper verification of a digital signature", _SECURITY, [347]),
    ("certificate-validation", "Improper certificate validation", _SECURITY, [295, 297]),
    ("persistent-cookie-exposure", "Information exposure through persistent cookies", _SECURITY, [539, 1004]),
    ("sensitive-comment", "Sensitive information in comments", _SECURITY, [615, 546]),
    ("hash-without-salt", "One-way hash without a salt", _SECURITY, [759, 760, 916]),
    ("code-download-without-integrity", "Download of code without integrity check", _SECURITY, [494, 1392]),
    ("no-login-throttling", "Improper restriction of excessive authentication attempts", _SECURITY, [307]),
    ("toctou", "Race condition (TOCTOU)", _TIME, [367, 362]),
    ("infinite-loop", "Infinite loop or recursion", _TIME, [835, 674]),
    ("error-message-exposure", "Information exposure through an error message", _ERROR, [209, 532]),
    ("missing-error-handling", "Missing error handling", _ERROR, [390, 391]),
    ("improper-exception-handling", "Improper exception handling", _ERROR, [248, 754]),
    ("null-dereference", "NULL pointer dereference", _CODE, [476]),
    ("resource-leak", "Improper resource release", _CODE, [404, 772]),
    ("use-after-free", "Use after free", _CODE, [416]),
    ("uninitialized-variable", "Use of an uninitialized variable", _CODE, [457]),
    ("untrusted-deserialization", "Deserialization of untrusted data", _CODE, [502]),
    ("wrong-session-exposure", "Data exposure through a wrong session", _CAPSULE, [488]),
    ("leftover-debug-code", "Leftover debug code", _CAPSULE, [489, 749]),
    ("private-array-returned", "Private array returned from a public method", _CAPSULE, [495]),
    ("public-data-to-private-array", "Public data assigned to a private array", _CAPSULE, [496]),
    ("dns-based-security-decision", "Security decision based on a DNS lookup", _API, [247, 292, 350]),
    ("dangerous-api", "Use of an inherently dangerous API", _API, [676, 242, 114, 926]),
]

_OWASP = "OWASP Top 10 2021"
OWASP = [
    ("A01", "Broken Access Control", _OWASP,
     [22, 23, 35, 59, 200, 201, 275, 276, 284, 285, 352, 359, 377, 425, 497, 538, 540, 548, 552, 601, 639, 668,
      706, 732, 862, 863, 913, 922, 98]),
    ("A02", "Cryptographic Failures", _OWASP,
     [259, 261, 296, 310, 311, 312, 319, 321, 322, 323, 324, 325, 326, 327, 328, 329, 330, 331, 335, 336, 337,
      338, 340, 347, 523, 720, 757, 759, 760, 780, 818, 916]),
    ("A03", "Injection", _OWASP,
     [20, 74, 75, 77, 78, 79, 80, 83, 87, 88, 89, 90, 91, 93, 94, 95, 96, 97, 99, 100, 113, 116, 134, 138, 184,
      470, 471, 564, 610, 643, 644, 652, 917]),
    ("A04", "Insecure Design", _OWASP,
     [73, 209, 256, 266, 269, 280, 311, 434, 501, 522, 525, 539, 579, 598, 602, 642, 646, 650, 653, 656, 657, 799,
      807, 840, 841, 927, 1021, 1173]),
    ("A05", "Security Misconfiguration", _OWASP,
     [2, 11, 13, 15, 16, 260, 315, 266, 520, 526, 537, 541, 547, 611, 614, 756, 776, 942, 1004, 1032, 1174, 489,
      546, 615, 749]),
    ("A06", "Vulnerable and Outdated Components", _OWASP, [937, 1035, 1104, 1352]),
    ("A07", "Identification and Authentication Failures", _OWASP,
     [255, 287, 288, 290, 294, 295, 297, 300, 302, 304, 306, 307, 346, 384, 521, 613, 620, 640, 798, 940, 1216]),
    ("A08", "Software and Data Integrity Failures", _OWASP,
     [345, 353, 426, 494, 502, 565, 784, 829, 830, 915, 1392]),
    ("A09", "Security Logging and Monitoring Failures", _OWASP, [117, 223, 532, 778]),
    ("A10", "Server-Side Request Forgery", _OWASP, [918]),
]

_WEB = "Web vulnerabilities"
EFS = [
    ("buffer-overflow", "Buffer overflow", _WEB, [119, 120, 121, 122, 125, 787]),
    ("format-string", "Format string", _WEB, [134]),
    ("ldap-injection", "LDAP injection", _WEB, [90]),
    ("os-command", "OS command execution", _WEB, [78, 77]),
    ("sql-injection", "SQL injection", _WEB, [89]),
    ("ssi-injection", "SSI injection", _WEB, [97]),
    ("xpath-injection", "XPath injection", _WEB, [643, 91, 652]),
    ("directory-indexing", "Directory indexing", _WEB, []),
    ("information-leak", "Information leakage", _WEB, [200, 209, 532, 546, 615, 359]),
    ("malicious-content", "Malicious content", _WEB, [94, 98]),
    ("xss", "Cross-site scripting", _WEB, [79, 80]),
    ("weak-password-policy", "Weak password strength", _WEB, [521, 522]),
    ("insufficient-authentication", "Insufficient authentication", _WEB, [287, 306, 798, 259, 1392]),
    ("weak-password-recovery", "Weak password recovery", _WEB, [640]),
    ("csrf", "Cross-site request forgery", _WEB, [352]),
    ("session-prediction", "Session prediction", _WEB, [330, 338, 340, 337]),
    ("insufficient-authorization", "Insufficient authorization", _WEB, [285, 862, 863, 732]),
    ("insufficient-session-expiration", "Insufficient session expiration", _WEB, [613]),
    ("session-fixation", "Session fixation", _WEB, [384]),
    ("automation-attack", "Automation attack", _WEB, [307, 799]),
    ("missing-process-validation", "Missing process validation", _WEB, [840, 841]),
    ("file-upload", "File upload", _WEB, [434]),
    ("file-download", "File download", _WEB, [73]),
    ("admin-page-exposure", "Admin page exposure", _WEB, []),
    ("path-traversal", "Path traversal", _WEB, [22, 23, 99]),
    ("location-disclosure", "Location disclosure", _WEB, [527, 538, 540]),
    ("cleartext-transmission", "Cleartext transmission", _WEB, [319, 311, 312, 295, 321, 326, 327]),
    ("cookie-tampering", "Cookie tampering", _WEB, [565, 614, 784, 1004, 539]),
]

#: CWE number -> name; one item each.
CWE_NAMES = {
    22: "Path Traversal", 78: "OS Command Injection", 79: "Cross-site Scripting", 89: "SQL Injection",
    90: "LDAP Injection", 94: "Code Injection", 98: "PHP Remote File Inclusion", 114: "Process Control",
    120: "Buffer Copy without Checking Size", 134: "Use of Externally-Controlled Format String",
    200: "Exposure of Sensitive Information", 295: "Improper Certificate Validation",
    321: "Use of Hard-coded Cryptographic Key", 327: "Use of a Broken Cryptographic Algorithm",
    338: "Cryptographically Weak PRNG", 359: "Exposure of Private Personal Information",
    489: "Active Debug Code", 502: "Deserialization of Untrusted Data",
    522: "Insufficiently Protected Credentials", 546: "Suspicious Comment", 601: "Open Redirect",
    611: "XML External Entity Reference", 615: "Information Exposure Through Comments", 643: "XPath Injection",
    749: "Exposed Dangerous Method or Function", 798: "Use of Hard-coded Credentials",
    918: "Server-Side Request Forgery", 926: "Improper Export of Android Components",
    1004: "Sensitive Cookie Without HttpOnly", 1392: "Use of Default Credentials",
}

MOBILE = [
    ("sql-injection", "SQL injection", _INPUT, [89]),
    ("path-resource-injection", "Path manipulation and resource injection", _INPUT, [22, 23, 73, 99]),
    ("xss", "Cross-site scripting", _INPUT, [79]),
    ("os-command-injection", "OS command injection", _INPUT, [77, 78]),
    ("overflow", "Overflow (integer, memory buffer)", _INPUT, [190, 119, 120, 680]),
    ("weak-crypto", "Use of a broken cryptographic algorithm", _SECURITY, [327, 326]),
    ("plaintext-storage", "Cleartext storage of sensitive information", _SECURITY, [312, 313, 922]),
    ("plaintext-transmission", "Cleartext transmission of sensitive information", _SECURITY, [319]),
    ("hardcoded-password", "Hardcoded password", _SECURITY, [259, 798]),
    ("weak-key-length", "Inadequate key length", _SECURITY, [326]),
    ("weak-random", "Use of an insufficiently random value", _SECURITY, [330, 338]),
    ("hardcoded-key", "Hardcoded cryptographic key", _SECURITY, [321, 798]),
    ("secret-in-comment", "Sensitive system information in a comment", _SECURITY, [615]),
    ("toctou", "Race condition (TOCTOU)", _TIME, [367]),
    ("error-info-exposure", "Information exposure through an error message", _ERROR, [209, 497]),
    ("missing-error-handling", "Missing error handling", _ERROR, [390, 544]),
    ("improper-exception", "Improper exception handling", _ERROR, [248, 396, 397]),
    ("null-deref", "Null pointer dereference", _CODE, [476]),
    ("resource-leak", "Improper release of a resource", _CODE, [404, 772]),
    ("dangerous-api", "Use of a dangerous API", _API, [242, 676]),
    ("android-component-exposure", "Improperly exported Android component", _MOBILE, [926]),
    ("implicit-intent", "Sensitive data sent through an implicit intent", _MOBILE, [927]),
    ("storage-without-access-control", "Storage used without access control", _MOBILE, [276, 922]),
    ("permission-bypass", "Android permission check bypass", _MOBILE, [284]),
    ("class-loading-hijack", "Class loading hijacking", _MOBILE, [470]),
    ("no-obfuscation", "Source code not obfuscated", _MOBILE, []),
]

_SESSION = "Session control"
#: Design-phase criteria look at documents, not code: no CWEs, so an item never passes.
MOIS_DESIGN = [
    ("dbms-query-validation", "DBMS query and result validation", _INPUT, []),
    ("xml-query-validation", "XML query and result validation", _INPUT, []),
    ("directory-query-validation", "Directory service query and result validation", _INPUT, []),
    ("resource-command-input-validation",
     "Input validation for system resource access and command execution", _INPUT, []),
    ("web-request-validation", "Web service request and response validation", _INPUT, []),
    ("critical-function-request-validation",
     "Validation of requests performing critical web functions", _INPUT, []),
    ("http-protocol-validation", "HTTP protocol validation", _INPUT, []),
    ("memory-access-in-range", "Memory access within allowed bounds", _INPUT, []),
    ("security-function-input-validation", "Input validation for security functions", _INPUT, []),
    ("file-transfer-validation", "Upload and download file validation", _INPUT, []),
    ("auth-target-and-method", "Authentication scope and method", _SECURITY, []),
    ("auth-attempt-limit", "Authentication attempt limiting", _SECURITY, []),
    ("password-management", "Password management", _SECURITY, []),
    ("critical-resource-access-control", "Critical resource access control", _SECURITY, []),
    ("key-management", "Cryptographic key management", _SECURITY, []),
    ("crypto-operation", "Cryptographic operations", _SECURITY, []),
    ("critical-data-storage", "Storage of critical information", _SECURITY, []),
    ("critical-data-transmission", "Transmission of critical information", _SECURITY, []),
    ("exception-design", "Exception handling design", _ERROR, []),
    ("session-control", "Session control", _SESSION, []),
]

# ---- end of fixed values -----------------------------------------------------------------

CHECKLISTS = {
    "mois": MOIS, "mois-design": MOIS_DESIGN, "mobile": MOBILE, "efs": EFS, "owasp": OWASP,
    "cwe": [(f"CWE-{n}", name, "CWE", [n]) for n, name in sorted(CWE_NAMES.items())],
}
ORDER = {name: i for i, name in enumerate(CHECKLISTS)}


def rows(*names: str) -> list[tuple]:
    """(std, std_ord, item_ord, code, name, grp, cwes) of the named checklists, or of all."""
    return [(std, i, j, code, name, grp, [f"CWE-{c}" for c in cwes])
            for i, std in enumerate(names or CHECKLISTS)
            for j, (code, name, grp, cwes) in enumerate(CHECKLISTS[std])]
