"""Fixed values that results of the llm operators depend on."""

# Frequent function words by language, as they are counted (ASCII letters lower-cased).
COMMON_WORDS = {
    "en": ["the", "of", "and", "a", "to", "in", "is", "was", "that", "for", "as", "on", "with", "by", "it", "this", "are", "be", "or", "at", "from", "an", "not", "which"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "mit", "von", "ist", "ein", "eine", "im", "nicht", "des", "auf", "für", "sich", "dem", "als", "auch", "es", "an", "er"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "est", "que", "du", "dans", "qui", "pour", "par", "au", "sur", "pas", "il", "plus", "ne", "ce", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es", "lo", "como", "más", "pero"],
}

# Character classes of the divergence rule, in the order of their histogram.
CHAR_CLASSES = ["lower", "upper", "digit", "blank", "newline", "stop", "bracket", "symbol", "other_ascii", "beyond_ascii"]
STOP_CHARS = ".,;:!?'\"-"
BRACKET_CHARS = "()[]{}"
SYMBOL_CHARS = "#*$%&|<>"

# Words in host names that mark a page as unwanted, to label URLs for training.
UNWANTED_HOST_WORDS = ["casino", "bets", "betting", "poker", "pills", "pharma", "adult", "xxx", "porn", "spam", "ads", "tracker", "malware", "phishing", "warez"]

# URL rules of the registered query: (verdict, host, path).
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

# Phrases whose places are counted, with their label.
LICENSE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licences: label, SPDX ids, a regex for the full name, one for the short name, one for the
# address, and keywords of which a text with the full or the short name holds one (all lower case).
LICENSES = [
    ("mit", ["mit"], r"(?:the )?mit license", r"mit", r"opensource\.org/licenses/mit\b", ["mit"]),
    ("mit-0", ["mit-0"], r"mit no attribution", r"mit-0", r"opensource\.org/licenses/mit-0", ["mit"]),
    ("apache-2.0", ["apache-2.0"], r"apache license,? (?:version |v)?2\.0", r"apache[ -]2(?:\.0)?", r"apache\.org/licenses/license-2\.0", ["apache"]),
    ("apache-1.1", ["apache-1.1"], r"apache (?:software )?license,? (?:version )?1\.1", r"apache[ -]1\.1", r"apache\.org/licenses/license-1\.1", ["apache"]),
    ("gpl-2.0", ["gpl-2.0-only", "gpl-2.0-or-later", "gpl-2.0"], r"gnu general public license,? (?:version |v)2", r"gpl ?v?2", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", ["general public license", "gpl"]),
    ("gpl-3.0", ["gpl-3.0-only", "gpl-3.0-or-later", "gpl-3.0"], r"gnu general public license,? (?:version |v)3", r"gpl ?v?3", r"gnu\.org/licenses/gpl-3\.0", ["general public license", "gpl"]),
    ("gpl", ["gpl"], r"gnu general public license", r"gpl", r"gnu\.org/licenses/gpl\b", ["general public license", "gpl"]),
    ("lgpl-2.1", ["lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-2.1"], r"gnu lesser general public license,? (?:version |v)2\.1", r"lgpl ?v?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", ["lesser general public", "lgpl"]),
    ("lgpl-3.0", ["lgpl-3.0-only", "lgpl-3.0-or-later", "lgpl-3.0"], r"gnu lesser general public license,? (?:version |v)3", r"lgpl ?v?3", r"gnu\.org/licenses/lgpl-3\.0", ["lesser general public", "lgpl"]),
    ("lgpl", ["lgpl"], r"gnu (?:lesser|library) general public license", r"lgpl", r"gnu\.org/licenses/lgpl\b", ["general public license", "lgpl"]),
    ("agpl-3.0", ["agpl-3.0-only", "agpl-3.0-or-later", "agpl-3.0"], r"gnu affero general public license", r"agpl(?: ?v?3)?", r"gnu\.org/licenses/agpl", ["affero", "agpl"]),
    ("gfdl", ["gfdl-1.2", "gfdl-1.3"], r"gnu free documentation license", r"gfdl", r"gnu\.org/licenses/fdl", ["free documentation license", "gfdl"]),
    ("bsd-2-clause", ["bsd-2-clause"], r"(?:2|two)[ -]clause bsd license|simplified bsd license|freebsd license", r"bsd[ -]2(?:[ -]clause)?", r"opensource\.org/licenses/bsd-2-clause", ["bsd"]),
    ("bsd-3-clause", ["bsd-3-clause"], r"(?:3|three)[ -]clause bsd license|(?:new|modified|revised) bsd license", r"bsd[ -]3(?:[ -]clause)?", r"opensource\.org/licenses/bsd-3-clause", ["bsd"]),
    ("bsd-4-clause", ["bsd-4-clause"], r"(?:4|four)[ -]clause bsd license|original bsd license", r"bsd[ -]4(?:[ -]clause)?", r"spdx\.org/licenses/bsd-4-clause", ["bsd"]),
    ("0bsd", ["0bsd"], r"zero[ -]clause bsd|bsd zero clause license", r"0bsd", r"opensource\.org/licenses/0bsd", ["bsd"]),
    ("bsd", ["bsd"], r"bsd license", r"bsd", r"opensource\.org/licenses/bsd-license", ["bsd"]),
    ("mpl-2.0", ["mpl-2.0"], r"mozilla public license,? (?:version |v\.? ?)?2\.0", r"mpl[ -]2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0", ["mozilla", "mpl"]),
    ("mpl-1.1", ["mpl-1.1"], r"mozilla public license,? (?:version |v\.? ?)?1\.1", r"mpl[ -]1\.1", r"mozilla\.org/mpl/mpl-1\.1", ["mozilla", "mpl"]),
    ("epl-1.0", ["epl-1.0"], r"eclipse public license,? (?:version |v\.? ?)?1\.0", r"epl[ -]1(?:\.0)?", r"eclipse\.org/legal/epl-v10", ["eclipse", "epl"]),
    ("epl-2.0", ["epl-2.0"], r"eclipse public license,? (?:version |v\.? ?)?2\.0", r"epl[ -]2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0", ["eclipse", "epl"]),
    ("cddl-1.0", ["cddl-1.0"], r"common development and distribution license", r"cddl", r"opensource\.org/licenses/cddl", ["common development and distribution", "cddl"]),
    ("cpl-1.0", ["cpl-1.0"], r"common public license", r"cpl[ -]1(?:\.0)?", r"opensource\.org/licenses/cpl", ["common public license", "cpl"]),
    ("isc", ["isc"], r"isc license", r"isc", r"opensource\.org/licenses/isc", ["isc"]),
    ("zlib", ["zlib"], r"zlib(?:/libpng)? license", r"zlib", r"zlib\.net/zlib_license", ["zlib"]),
    ("libpng", ["libpng", "libpng-2.0"], r"libpng license|png reference library license", r"libpng", r"libpng\.org/pub/png/src/libpng-license", ["png"]),
    ("unlicense", ["unlicense"], r"the unlicense|free and unencumbered software released into the public domain", r"unlicense", r"unlicense\.org", ["unlicense", "unencumbered"]),
    ("wtfpl", ["wtfpl"], r"do what the f\w+ you want to public license", r"wtfpl", r"wtfpl\.net", ["do what the f", "wtfpl"]),
    ("bsl-1.0", ["bsl-1.0"], r"boost software license", r"bsl[ -]1(?:\.0)?", r"boost\.org/license_1_0", ["boost", "bsl"]),
    ("artistic-1.0", ["artistic-1.0", "artistic-1.0-perl"], r"artistic license,? (?:version )?1\.0", r"artistic[ -]1(?:\.0)?", r"opensource\.org/licenses/artistic-license-1\.0", ["artistic"]),
    ("artistic-2.0", ["artistic-2.0"], r"artistic license,? (?:version )?2\.0", r"artistic[ -]2(?:\.0)?", r"opensource\.org/licenses/artistic-license-2\.0", ["artistic"]),
    ("psf-2.0", ["psf-2.0", "python-2.0"], r"python software foundation license", r"psf license", r"python\.org/psf/license", ["python software foundation", "psf"]),
    ("ofl-1.1", ["ofl-1.1"], r"sil open font license", r"ofl[ -]1\.1", r"scripts\.sil\.org/ofl", ["sil open font", "ofl"]),
    ("eupl-1.2", ["eupl-1.1", "eupl-1.2"], r"european union public licen[cs]e", r"eupl", r"joinup\.ec\.europa\.eu/\S{0,60}eupl", ["european union public", "eupl"]),
    ("ms-pl", ["ms-pl"], r"microsoft public license", r"ms-pl", r"opensource\.org/licenses/ms-pl", ["microsoft public", "ms-pl"]),
    ("ms-rl", ["ms-rl"], r"microsoft reciprocal license", r"ms-rl", r"opensource\.org/licenses/ms-rl", ["microsoft reciprocal", "ms-rl"]),
    ("ncsa", ["ncsa"], r"university of illinois/ncsa open source license", r"ncsa", r"opensource\.org/licenses/ncsa", ["ncsa"]),
    ("postgresql", ["postgresql"], r"postgresql licen[cs]e", r"postgresql licensed", r"postgresql\.org/about/licence", ["postgresql"]),
    ("ruby", ["ruby"], r"ruby license", r"ruby licensed", r"ruby-lang\.org/\S{0,20}/license", ["ruby"]),
    ("cc0-1.0", ["cc0-1.0"], r"creative commons (?:cc0|zero)(?: 1\.0)?(?: universal)?", r"cc0(?:[ -]1\.0)?", r"creativecommons\.org/publicdomain/zero", ["creative commons", "cc0"]),
    ("cc-by", ["cc-by-3.0", "cc-by-4.0", "cc-by-2.0"], r"creative commons attribution(?: \d\.\d)? (?:international )?licen[cs]e", r"cc[ -]by(?: \d\.\d)?", r"creativecommons\.org/licenses/by/", ["creative commons attribution", "cc-by", "cc by"]),
    ("cc-by-sa", ["cc-by-sa-3.0", "cc-by-sa-4.0"], r"creative commons attribution[ -]share ?alike", r"cc[ -]by[ -]sa(?: \d\.\d)?", r"creativecommons\.org/licenses/by-sa/", ["creative commons attribution", "cc-by", "cc by"]),
    ("cc-by-nc", ["cc-by-nc-3.0", "cc-by-nc-4.0"], r"creative commons attribution[ -]non ?commercial", r"cc[ -]by[ -]nc(?: \d\.\d)?", r"creativecommons\.org/licenses/by-nc/", ["creative commons attribution", "cc-by", "cc by"]),
    ("cc-by-nd", ["cc-by-nd-3.0", "cc-by-nd-4.0"], r"creative commons attribution[ -]no ?deriv(?:ative)?s", r"cc[ -]by[ -]nd(?: \d\.\d)?", r"creativecommons\.org/licenses/by-nd/", ["creative commons attribution", "cc-by", "cc by"]),
    ("cc-by-nc-sa", ["cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"], r"creative commons attribution[ -]non ?commercial[ -]share ?alike", r"cc[ -]by[ -]nc[ -]sa(?: \d\.\d)?", r"creativecommons\.org/licenses/by-nc-sa/", ["creative commons attribution", "cc-by", "cc by"]),
    ("cc-by-nc-nd", ["cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"], r"creative commons attribution[ -]non ?commercial[ -]no ?deriv(?:ative)?s", r"cc[ -]by[ -]nc[ -]nd(?: \d\.\d)?", r"creativecommons\.org/licenses/by-nc-nd/", ["creative commons attribution", "cc-by", "cc by"]),
    ("public-domain", ["public-domain"], r"(?:released|placed|dedicated) (?:in)?to the public domain", r"public domain", r"creativecommons\.org/publicdomain/mark", ["public domain"]),
    ("proprietary", ["licenseref-proprietary"], r"all rights reserved", r"proprietary and confidential", r"licenseref-proprietary", ["all rights reserved", "proprietary and confidential"]),
]
