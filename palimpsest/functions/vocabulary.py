"""Word lists and tables that results depend on."""

# Fixed values.
HIGH_SLUGS = (
    "contact contacts contact-us contactus get-in-touch reach-us about about-us aboutus company team staff people leadership "
    "management imprint impressum legal footer support help kontakt kontakty kontakti svyaz obratnaya-svyaz obratnaya_svyaz o-nas o_nas onas "
    "o-kompanii o_kompanii rekvizity ueber-uns ueberuns nous-contacter a-propos contacto contatti chi-siamo quienes-somos "
    "контакты контакт о-нас о_нас о-компании о_компании реквизиты обратная-связь связь über-uns à-propos"
).split()
LOW_SLUGS = "tag tags category categories search feed rss comments trackback page wp-content wp-admin wp-includes static assets media img images css js".split()
ASSET_EXTENSIONS = "png jpg jpeg gif css js ico woff pdf zip xml".split()
EMAIL_ASSETS = ".png .jpg .jpeg .gif .svg .webp .css .js .woff .woff2 .ttf .ico".split()
PROSE_WORDS = "available archived based found headquartered hosted listed located registered stationed displayed offered presented showcased stored published".split()
WELL_KNOWN_PATHS = tuple(
    (
        "/ /contact /contacts /contact.html /contacts.html /contact.htm /contacts.htm /contact-us /contact-us.html /contact.php /contacts.php "
        "/about /about.html /about-us /about-us.html /company /team /imprint /impressum /index.html /footer.html "
        "/kontakty /kontakty.html /o-nas /o-kompanii /rekvizity /контакты /о-нас /о-компании"
    ).split()
)
PROBE_STAMPS = ("19990101", "20050101", "20100101", "20150101", "20200101")
#: Top-level domains whose region is their own code in capitals; the two below differ.
COUNTRY_TLDS = (
    "ru by ua kz md uz tj kg tm am az ge gb ie de at ch fr be lu nl it es pt gr pl cz sk hu ro bg hr si rs ba mk al ee lv lt "
    "se no fi dk is us ca au nz za tr il ae sa qa kw bh om jo lb eg jp cn hk tw kr sg my th vn id ph in pk bd lk "
    "mx br ar cl pe ve uy py bo ec ng ke gh ma tn dz"
).split()
GENERIC_TLDS = "com org net io co app ai dev tech info biz xyz".split()
TLD_REGION = {**{t: t.upper() for t in COUNTRY_TLDS}, "uk": "GB", **dict.fromkeys(GENERIC_TLDS, "US")}
SCAN_REGIONS = ("RU", "BY", "UA", "KZ", "US", "GB", "DE", "FR")
PAGE_REGIONS = ("RU", "US", "GB", "DE", "FR")
ARCHIVE = "https://web.archive.org/web/"

ASCII_SLUGS = sorted(s for s in HIGH_SLUGS if s.isascii())
