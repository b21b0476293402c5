"""Fixed values. Results must equal published ones, so these lists, patterns and
thresholds are constants; everything larger (spelling dictionary, technology
fingerprints, topic terms) is a table the caller passes in."""

# ---- severities, worst first; any other word weighs UNKNOWN_SEVERITY
SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
UNKNOWN_SEVERITY = 9

# ---- fixed values: URL handling
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "mc_cid", "mc_eid", "yclid", "msclkid", "_ga",
]
NON_PAGE_SCHEMES = ["mailto:", "tel:", "sms:", "javascript:", "data:", "blob:", "file:", "ftp:"]
SECOND_LEVEL_LABELS = ["co", "com", "org", "net", "gov", "edu", "ac"]
ASSET_PATH = (
    r"(?i)\.(png|jpe?g|gif|svg|webp|ico|bmp|avif|css|js|mjs|json|xml|txt|woff2?|ttf|eot|"
    r"pdf|zip|rar|7z|tar|gz|mp4|mp3|wav|avi|mov|webm|apk|exe|dmg|csv|xlsx?|docx?|pptx?)($|\?)"
)
DOCUMENT_PATH = r"(?i)\.(pdf|docx?|xlsx?|pptx?|csv|txt)($|\?)"
UNSAFE_URL_PATTERNS = [
    r"/logout", r"/log-out", r"/signout", r"/sign-out", r"/exit",
    r"/unsubscribe", r"/delete", r"/remove", r"/destroy",
    r"[?&]action=(delete|logout|remove|destroy)",
    r"/wp-login\.php\?action=logout",
    r"\.(zip|rar|7z|tar|gz|exe|dmg|pkg|msi|iso|mp4|mp3|avi|mov|wav|apk)$",
]

# ---- fixed values: hosts that every site links to
UTILITY_DOMAINS = [
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com",
    "youtube.com", "youtu.be", "tiktok.com", "pinterest.com", "reddit.com",
    "snapchat.com", "threads.net", "bsky.app", "mastodon.social", "vk.com",
    "t.me", "telegram.me", "telegram.org", "whatsapp.com", "wa.me", "discord.com", "discord.gg",
    "bit.ly", "tinyurl.com", "buff.ly", "ow.ly", "lnkd.in", "goo.gl", "t.co",
    "google.com", "gstatic.com", "googleapis.com", "googletagmanager.com",
    "doubleclick.net", "gravatar.com", "apple.com", "microsoft.com",
    "servedbyadbutler.com", "adbutler.com", "adsrvr.org", "criteo.com",
    "outbrain.com", "taboola.com", "scorecardresearch.com",
    "amazon.com", "adobe.com", "cloudflare.com", "jsdelivr.net", "unpkg.com",
    "cdnjs.com", "fontawesome.com", "bootstrapcdn.com", "w3.org", "schema.org",
    "wordpress.org", "wordpress.com", "wp.com",
    "wikipedia.org", "archive.org", "github.io", "gmail.com", "outlook.com",
    "play.google.com", "apps.apple.com", "itunes.apple.com",
    "spotify.com", "podcasts.apple.com", "soundcloud.com", "vimeo.com",
    "flickr.com", "beehiiv.com", "substack.com", "medium.com", "ghost.org",
    "mailchimp.com", "hubspot.com", "onetrust.com", "cookiebot.com",
    "eventbrite.com", "calendly.com", "typeform.com", "disqus.com",
    "creativecommons.org", "oracle.com", "salesforce.com",
    "cookiepedia.co.uk", "aboutcookies.org", "allaboutcookies.org",
    "aboutads.info", "youronlinechoices.com", "youronlinechoices.eu",
    "networkadvertising.org", "optout.aboutads.info", "iabeurope.eu",
    "qualtrics.com", "trustarc.com", "usercentrics.com",
    "mozilla.org", "opera.com", "firefox.com", "chrome.com", "brave.com",
]

# ---- fixed values: business infrastructure that says nothing about a subject
INFRASTRUCTURE_DOMAINS = [
    "myworkdayjobs.com", "workday.com", "greenhouse.io", "lever.co",
    "smartrecruiters.com", "workable.com", "bamboohr.com", "jobvite.com",
    "icims.com", "taleo.net", "successfactors.com", "ashbyhq.com",
    "cryptojobslist.com", "efinancialcareers.com", "web3.career",
    "cryptocurrencyjobs.co", "indeed.com", "glassdoor.com",
    "cvent.com", "cvent.me", "cventevents.com", "eventbrite.com", "hopin.com",
    "goldcast.io", "on24.com", "zoom.us", "gotowebinar.com", "bigmarker.com",
    "luma.com", "lu.ma", "meetup.com", "sessionize.com",
    "iqpc.com", "informa.com", "ibc-asia.com", "arena-international.com",
    "bc.events", "blockchainlive.com", "iblockchainsummit.com",
    "prnewswire.com", "businesswire.com", "globenewswire.com", "prweb.com",
    "einpresswire.com", "accesswire.com", "newswire.com", "buysub.com",
    "gartner.com", "forrester.com", "g2.com", "capterra.com", "trustradius.com",
    "trustpilot.com", "clutch.co", "softwareadvice.com",
    "futuremarketinsights.com", "marketsandmarkets.com",
    "grandviewresearch.com", "statista.com", "mordorintelligence.com",
    "sitecore.com", "outsystems.com", "qlik.com", "salesforce.com", "hubspot.com",
    "marketo.com", "pardot.com", "wix.com", "squarespace.com", "webflow.com",
    "shopify.com", "drupal.org", "contentful.com", "blueprism.com",
    "site.com", "force.com", "sharepoint.com", "atlassian.net",
    "github.com", "gitlab.com", "bitbucket.org", "readthedocs.io", "npmjs.com",
    "pypi.org", "stackoverflow.com", "arxiv.org", "doi.org", "researchgate.net",
    "nytimes.com", "wsj.com", "washingtonpost.com", "bbc.co.uk", "cnn.com",
    "whitehouse.gov", "usa.gov", "justice.gov", "congress.gov", "govinfo.gov",
    "artnews.com", "forbesmagazine.com",
]

# ---- fixed values: text
ENGLISH_STOP_WORDS = [
    "the", "and", "to", "of", "a", "in", "is", "you", "your", "for", "with", "on",
    "our", "we", "are", "this", "that", "it", "be", "as", "or", "by", "from", "at",
]
VALID_SPELLING_PAIRS = [
    ("fulfill", "fulfil"), ("enroll", "enrol"), ("enrollment", "enrolment"),
    ("install", "instal"), ("installment", "instalment"), ("skillful", "skilful"),
    ("willful", "wilful"), ("distill", "distil"), ("instill", "instil"), ("appall", "appal"),
    ("dullness", "dulness"), ("fullness", "fulness"), ("deserts", "desserts"),
    ("desert", "dessert"), ("woollen", "woolen"), ("jewellery", "jewelery"),
]
DOUBLING_SUFFIXES = ["ing", "ings", "ed", "er", "ers", "est", "en", "y", "ie", "ies", "ish", "able"]
JUNK_TEXT_PATTERNS = [
    ("lorem ipsum", r"(?i)lorem ipsum"),
    ("undefined", r"(^|[\s>|:,])undefined([\s<|.,!]|$)"),
    ("NaN", r"(^|[\s>|:,])NaN([\s<|.,!]|$)"),
    ("[object Object]", r"\[object Object\]"),
    ("TODO/FIXME", r"\b(TODO|FIXME|XXX):"),
    ("null value shown", r"(^|[\s>|:,])null([\s<|.,!]|$)"),
    ("template placeholder", r"\{\{\s*[\w.$]+\s*\}\}|%[A-Z_]{3,}%"),
    ("Error text", r"\b(Exception|Stack trace|Fatal error|Warning: |Notice: |Traceback \(most recent)"),
    ("test placeholder", r"(?i)\b(test test|asdf|qwerty|placeholder text|coming soon)\b"),
]
JUNK_TEXT_HIGH = ["Error text", "[object Object]", "undefined", "NaN"]

# ---- fixed values: words on controls that could do damage
DANGER_PATTERNS = [
    r"\bdelete\b", r"\bremove\b", r"\bdestroy\b", r"\berase\b", r"\bwipe\b",
    r"\bdeactivate\b", r"\bdisable account\b", r"\bclose account\b",
    r"\bcancel (subscription|account|order|plan)\b", r"\bunsubscribe\b",
    r"\bterminate\b", r"\bpay\b", r"\bpayment\b", r"\bcheckout\b", r"\bbuy\b",
    r"\bpurchase\b", r"\border now\b", r"\bdonate\b",
    r"\bconfirm order\b", r"\bplace order\b", r"\bwithdraw\b", r"\btransfer\b",
    r"\bsend money\b", r"\bblock user\b", r"\breset\b",
    r"\bfactory reset\b", r"\brestore defaults\b",
    r"\blog ?out\b", r"\bsign ?out\b", r"\bexit\b",
    r"\bpublish\b", r"\bdeploy\b", r"\bsend invite\b",
    r"\bsil\b", r"\bsilin\b", r"\bs[iı]l[mn]", r"\bl[əe][ğg]v\b", r"\bl[əe][ğg]v et\b",
    r"\b[öo]d[əe]\b", r"\b[öo]d[əe]ni[şs]\b", r"\bsat[ıi]n al\b", r"\bsifari[şs]\b",
    r"\b[çc][ıi]x[ıi][şs]\b", r"\bhesab[ıi] ba[ğg]la\b", r"\bblokla\b",
    r"\bg[öo]nd[əe]r pul\b", r"\byay[ıi]mla\b",
    r"\bудалить\b", r"\bоплатить\b", r"\bвыйти\b", r"\bотменить\b",
]
SOFT_DANGER_WORDS = ["pay", "payment", "buy", "purchase", "donate"]
READING_CONTEXT = (
    r"(?iU)\b(history|how|what|when|where|why|faq|info|information|details|statistics|stats|"
    r"reports?|terms|polic(y|ies)|methods?|options?|overview|list|status)\b|\?"
)

# ---- fixed values: captured traffic
AUTH_PROBE_PATH = (
    r"(?i)(auth|token|refresh|session|login|logout|sign-?in|profile|account|whoami|"
    r"(^|/)me(/|$)|(^|/)users?/(me|current|self)|current-?user|csrf|oauth|jwt|identity|permission)"
)
IGNORABLE_CONSOLE = (
    r"(?i)(favicon\.ico|Download the React DevTools|Lighthouse|chrome-extension://|"
    r"DevTools failed to load source ?map|was preloaded using link preload but not used|"
    r"Third-party cookie will be blocked|Failed to load resource: the server responded)"
)
NOTABLE_WARNING = r"(?i)(deprecat|violation|failed|cannot|blocked|insecure|mixed content)"
CLIPBOARD_WHY = r"(?i)permission|denied|not ?allowed|focus"
ERRORISH_PAGE = r"(?iU)\b(error|failed|failure|something went wrong|try again|could not|couldn't|unable to)\b"
EMPTY_MESSAGE = (
    r"(?iU)^\s*(no|zero)\s+[a-z]|\b(empty|nothing found|no (data|results?|records?|entries|items?))\b"
)
NOT_EMPTY_MESSAGE = (
    r"(?i)permission|authori[sz]|forbidden|token|credential|log ?in|denied|invalid|"
    r"required|missing|must|expired|not allowed|access|exceed|limit"
)
MESSAGE_FIELD = r'(?i)"(?:message|detail|error|msg|description)"\s*:\s*"([^"]{1,300})"'
TOKEN_LIKE = r"eyJ[\w-]+\.[\w-]+\.[\w-]*"
ERROR_TEXT = (
    r"(?iU)(\berror\b|failed|failure|invalid|exception|something went wrong|try again|"
    r"\bwrong\b|incorrect|do(es)? not match|required|must be|not found|"
    r"x[əe]ta|s[əe]hv|al[ıi]nmad[ıi]|yanl[ıi][şs]|ошибка|не удалось|неверн)"
)
SUCCESS_TEXT = r"(?iU)(thank you|success|sent|received|submitted|saved|təşəkkür|göndərildi|uğurla|успешно)"
OFFLINE_MARKERS = [
    "ERR_NAME_NOT_RESOLVED", "ERR_INTERNET_DISCONNECTED",
    "ERR_NETWORK_CHANGED", "ERR_ADDRESS_UNREACHABLE",
    "ERR_PROXY_CONNECTION_FAILED", "ERR_NAME_RESOLUTION_FAILED",
]
SECURITY_HEADERS = [
    ("content-security-policy", "Content-Security-Policy", "low"),
    ("x-content-type-options", "X-Content-Type-Options", "low"),
    ("referrer-policy", "Referrer-Policy", "info"),
    ("x-frame-options", "X-Frame-Options", "low"),
    ("strict-transport-security", "Strict-Transport-Security", "low"),
]
#: Standard HTTP reason phrases.
STATUS_MEANING = {
    400: "Bad Request",
    401: "Unauthorized",
    403: "Forbidden",
    404: "Not Found",
    405: "Method Not Allowed",
    409: "Conflict",
    410: "Gone",
    422: "Unprocessable Content",
    429: "Too Many Requests",
}
EXPOSED_PATHS = [
    ("/.env", "critical", "Environment file with secrets"),
    ("/.git/config", "critical", "Git repository metadata"),
    ("/.git/HEAD", "critical", "Git repository metadata"),
    ("/.DS_Store", "low", "macOS directory index"),
    ("/phpinfo.php", "high", "PHP configuration dump"),
    ("/server-status", "medium", "Apache status page"),
    ("/.svn/entries", "high", "Subversion metadata"),
    ("/backup.zip", "high", "Site backup archive"),
    ("/backup.sql", "critical", "Database dump"),
    ("/db.sql", "critical", "Database dump"),
    ("/wp-config.php.bak", "critical", "WordPress config backup"),
    ("/config.php.bak", "critical", "Config backup"),
    ("/.env.local", "critical", "Environment file with secrets"),
    ("/composer.lock", "info", "Dependency manifest"),
    ("/package.json", "info", "Dependency manifest"),
]
SECURITY_TXT = "/.well-known/security.txt"
JSON_ONLY_PATHS = ["/package.json", "/composer.lock"]
IMPACT_SEVERITY = [("critical", "high"), ("serious", "medium"), ("moderate", "low"), ("minor", "info")]
A11Y_SKIPPED_RULES = [
    "image-alt", "html-has-lang", "duplicate-id", "duplicate-id-active",
    "duplicate-id-aria", "meta-viewport", "document-title", "link-name",
    "label", "button-name", "page-has-heading-one", "frame-title",
]
SEARCH_FORM = r"(?i)search|axtar|поиск|filter|query"
PERSONAL_FIELD = (
    r"(?i)(e-?mail|user ?name|login|phone|mobile|first.?name|last.?name|full.?name|surname|"
    r"given.?name|family.?name|address|post.?code|zip|city|country)"
)
OPTIONAL_LABEL = r"(?iu)\boptional\b|\(opt\.?\)|isteğe bağlı|ixtiyari|məcburi deyil|необязательн"
CDN_NEEDLES = [
    ("cloudflare", "Cloudflare"), ("cf-ray", "Cloudflare"),
    ("x-amz-cf", "Amazon CloudFront"), ("cloudfront", "Amazon CloudFront"),
    ("x-vercel", "Vercel"), ("x-fastly", "Fastly"),
    ("x-akamai", "Akamai"), ("x-cache", "CDN (x-cache)"), ("netlify", "Netlify"),
]
TECH_CATEGORY_PRIORITY = [
    "CMS", "Ecommerce", "JavaScript frameworks", "Web frameworks",
    "Programming languages", "Web servers", "PaaS", "CDN",
    "Analytics", "Tag managers", "Databases",
]
LAB_METRICS = [
    ("largest-contentful-paint", "lcp"), ("cumulative-layout-shift", "cls"),
    ("total-blocking-time", "tbt"), ("first-contentful-paint", "fcp"),
    ("speed-index", "si"), ("interactive", "tti"),
]
FIELD_METRICS = [
    ("LARGEST_CONTENTFUL_PAINT_MS", "lcp_ms"), ("INTERACTION_TO_NEXT_PAINT", "inp_ms"),
    ("CUMULATIVE_LAYOUT_SHIFT_SCORE", "cls"), ("FIRST_CONTENTFUL_PAINT_MS", "fcp_ms"),
    ("EXPERIMENTAL_TIME_TO_FIRST_BYTE", "ttfb_ms"),
]

# ---- fixed values: thresholds
SLOW_LOAD_MS = 5000
SLOW_TTFB_MS = 1500
HEAVY_PAGE_KB = 3000
MAX_ATTEMPTS = 3
MIN_REFDOMS_TO_RANK = 2
