"""Authored labelled phrases the page models start from.

The models take single words from them, and how they begin.  No phrase of three words and more, and none of the
seed of residue, stands in the test tables as it is here; single words and pairs of what stands around pages do.
"""

# What stands around the main body of pages.
AROUND = {
    "en": """
home|news|contact|contact us|about|about us|shop|store|cart|basket (0)|sign in|log in|register|help|support|careers|jobs|press|calendar|opening hours|gift cards|search|menu|my account|sitemap|archive|tags|categories
this website uses cookies to improve your experience|we and our partners process personal data for adverts|accept all cookies|manage preferences|by continuing to browse you agree to their use|we store small files on your device
© 2021 All rights reserved.|privacy policy|legal notice|imprint|registered office: 5 Example Street|made with care in Exampletown|follow us on social media
subscribe and never miss a story|get stories in your inbox|support our work with a donation|rate our app|leave a comment|join the discussion
advertisement|sponsored content|read also: another story|related articles|most read|recommended for you|more from this site|latest posts|trending now
newsletter|subscribe|advert|advertising|share|friends|app|download|member|membership|donate|read also|see also: a story|sponsor
""",
    "de": """
Startseite|Neuigkeiten|Kontakt|Über uns|Laden|Warenkorb (0)|Anmelden|Registrieren|Hilfe|Karriere|Presse|Kalender|Suche|Mein Konto|Archiv|Schlagwörter
Wir verwenden Cookies, um die Seite zu verbessern|Mit der weiteren Nutzung stimmen Sie zu|Alle akzeptieren|Einstellungen verwalten|Ihre Privatsphäre ist uns wichtig
© 2021 Alle Rechte vorbehalten.|Impressum|Datenschutz|AGB|Folgen Sie uns
Newsletter abonnieren und nichts verpassen|Mitglied werden|Teilen Sie diese Seite mit Freunden|Laden Sie unsere App herunter
Anzeige|Anzeige – weiter lesen|Werbung|Lesen Sie auch: ein Beitrag|Ähnliche Beiträge|Meistgelesen|Das könnte Sie auch interessieren
Rundbrief|abonnieren|Newsletter|Werbung|teilen|Freunde|App|herunterladen|Mitglied|Mitgliedschaft|spenden
""",
    "fr": """
Accueil|Actualités|Contact|À propos|Boutique|Panier (0)|Connexion|Aide|Agenda|Presse|Recherche|Mon compte|Archives|Mots-clés
Nous utilisons des cookies pour mesurer les visites|Tout accepter|Gérer mes choix|Votre vie privée compte pour nous
© 2021 Tous droits réservés.|Mentions légales|Confidentialité|Suivez-nous
Inscrivez-vous à la newsletter|Devenez membre|Partagez cette page avec vos amis|Téléchargez notre application
Publicité|À lire aussi : un article|Articles liés|Les plus lus|Vous aimerez aussi
infolettre|abonnement|abonnez|inscription|publicité|partager|amis|application|télécharger|membre|don
""",
    "es": """
Inicio|Noticias|Contacto|Quiénes somos|Tienda|Carrito (0)|Entrar|Ayuda|Agenda|Prensa|Buscar|Mi cuenta|Archivo|Etiquetas
Usamos cookies para medir las visitas|Aceptar todo|Configurar|Su privacidad nos importa
© 2021 Todos los derechos reservados.|Aviso legal|Privacidad|Síganos
Hágase socio|Comparta esta página con sus amigos|Descargue nuestra aplicación
Publicidad|Lea también: otra historia|Artículos relacionados|También le puede interesar
boletín|suscripción|suscribirse|suscríbase|publicidad|compartir|amigos|aplicación|descargar|socio|donar|lea también
""",
    "pt": """
Início|Notícias|Contacto|Sobre nós|Loja|Cesto (0)|Entrar|Ajuda|Agenda|Imprensa|Pesquisa|A minha conta|Arquivo|Etiquetas
Usamos cookies para medir as visitas|Aceitar tudo|Gerir preferências|A sua privacidade é importante
© 2021 Todos os direitos reservados.|Aviso legal|Privacidade|Preços com impostos, envio à parte|Siga-nos
Torne-se sócio|Partilhe esta página com os amigos|Descarregue a nossa aplicação
Publicidade|Leia também: outra história|Artigos relacionados|Mais lidos|Também lhe pode interessar
boletim|assinatura|assinar|assine|publicidade|partilhar|amigos|aplicação|descarregar|sócio|doar|leia também
""",
    "it": """
Inizio|Notizie|Contatti|Chi siamo|Negozio|Carrello (0)|Accedi|Aiuto|Agenda|Stampa|Cerca|Il mio account|Archivio|Etichette
Usiamo i cookie per misurare le visite|Accetta tutto|Gestisci le preferenze|La tua privacy è importante
© 2021 Tutti i diritti riservati.|Note legali|Riservatezza|Prezzi con tasse, spedizione esclusa|Seguici
Diventa socio|Condividi questa pagina con gli amici|Scarica la nostra app
Pubblicità|Leggi anche: un'altra storia|Articoli correlati|Ti potrebbe interessare
bollettino|abbonamento|iscriviti|iscrizione|pubblicità|condividere|amici|applicazione|scaricare|socio|donare|leggi anche
""",
    "nl": """
Start|Nieuws|Contact|Over ons|Winkel|Mandje (0)|Inloggen|Hulp|Agenda|Pers|Zoeken|Mijn account|Archief|Labels
Wij gebruiken cookies om bezoeken te meten|Alles accepteren|Voorkeuren beheren|Uw privacy is belangrijk
© 2021 Alle rechten voorbehouden.|Voorwaarden|Privacy|Prijzen inclusief btw, exclusief verzending|Volg ons
Word lid|Deel deze pagina met vrienden|Download onze app
Advertentie|Lees ook: een ander verhaal|Verwante artikelen|Meest gelezen|Misschien ook interessant
nieuwsbrief|abonneren|aanmelden|advertentie|reclame|delen|vrienden|app|downloaden|lid|doneren|lees ook
""",
    "ru": """
Главная|Новости|Контакты|О нас|Магазин|Корзина (0)|Войти|Помощь|Афиша|Пресса|Поиск|Мой кабинет|Архив|Метки
Мы используем файлы cookie, чтобы считать посещения|Принять все|Настройки|Ваша конфиденциальность важна
© 2021 Все права защищены.|Правила|Конфиденциальность|Цены с налогом, доставка отдельно|Следите за нами
Станьте участником|Поделитесь этой страницей с друзьями|Скачайте наше приложение
Реклама|Читайте также: ещё один рассказ|Похожие статьи|Самое читаемое|Вам может быть интересно
рассылка|рассылку|подписка|подписаться|подпишитесь|реклама|поделиться|друзьями|приложение|скачать|участник|пожертвовать|читайте также
""",
    "ja": """
ホーム|お知らせ|会社案内|お店|かご (0)|ログイン|ヘルプ|予定|採用|検索|タグ
このサイトは訪問数の計測のためにクッキーを使います。|すべて許可|設定
© 2021 無断転載を禁じます|利用規約|個人情報|税込価格、送料別|フォローする
お便りに登録して見逃さないでください。|会員になる|友だちに共有する|アプリをダウンロード
広告|広告 – 続きは下|こちらもどうぞ|関連記事|おすすめ
登録|購読|お便り|広告|共有|アプリ|会員|寄付|こちらもどうぞ
""",
    "zh": """
首页|新闻|联系|关于我们|商店|登录|帮助|日程|招聘|搜索|标签
我们使用Cookie来统计访问量。|全部接受|设置
© 2021 版权所有|使用条款|隐私|价格含税，运费另计|关注我们
成为会员|分享给朋友|下载我们的应用
广告|另请阅读|相关文章|最受欢迎|推荐
订阅|通讯|广告|分享|应用|会员|捐款|另请阅读
""",
}

# A short general seed of messages, notices and stand-in copy; the rest is learned from trusted records.
RESIDUE = {
    "en": "404 not found|page not found|an unexpected error occurred|the site is temporarily offline|site under maintenance|complete the captcha to continue|turn javascript on to continue|your text here|this is a sample post|edit this text|lorem ipsum",
    "de": "Hier steht ein Beispieltext|Platzhaltertext|Die Seite wurde nicht gefunden",
    "fr": "Texte d’exemple à remplacer|La page est introuvable",
    "es": "Acceso denegado|Página inexistente",
    "pt": "Acesso negado|Texto de exemplo",
    "it": "Accesso negato|Testo di esempio",
    "nl": "Toegang geweigerd|Voorbeeldtekst",
    "ru": "Доступ запрещён|Текст для примера",
    "ja": "ページが見つかりません。|ここに文章が入ります。",
    "zh": "找不到网页。|此处为示例文字。",
}

# Sentences that write about residue.
ABOUT = {
    "en": """a template writes {{ name }} where the value will be set|templates hold variables like {{ title }} that are filled later|the variable ${HOME} names a directory in the shell|the value undefined means that nobody set a field|designers use lorem ipsum as filler in a draft
the message page not found should say what to do next|a missing page answers with status 404 and a short text|readers who block scripts cannot use a page that needs javascript|our log keeps the cause of an internal server error|we wrote the notice for the maintenance in plain words|a todo left in a page is the sign of a hurried launch""",
}


def phrases(table: dict[str, str]) -> list[tuple[str, str]]:
    """(language, phrase) of a table."""
    return [(lang, p.strip()) for lang, text in table.items() for p in text.replace("\n", "|").split("|") if p.strip()]

# Words of the usual Latin filler text.
FILLER = """
ac accumsan ad adipiscing aenean aliquam aliquet aliquip amet ante anim arcu at auctor augue aute bibendum blandit cillum commodo condimentum
congue consectetur consequat convallis cras culpa cupidatat curabitur cursus dapibus deserunt diam dictum dignissim dolor dolore donec duis
efficitur egestas eget eiusmod eleifend elementum elit enim erat eros esse est etiam euismod excepteur exercitation facilisis fames faucibus
felis fermentum feugiat finibus fringilla fugiat fusce gravida habitant hendrerit iaculis id imperdiet incididunt integer interdum ipsum irure
justo labore laboris laborum lacinia lacus laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada massa mattis mauris
maximus metus minim molestie mollis mollit morbi nec neque nibh nisl nostrud nulla nullam nunc occaecat odio officia orci ornare pariatur
pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium proident proin pulvinar purus quam quis quisque rhoncus risus
rutrum sagittis sapien scelerisque sed sem semper senectus sint sit sodales sollicitudin sunt suscipit suspendisse tellus tempor tempus
tincidunt tortor tristique turpis ullamco ullamcorper ultrices ultricies urna ut varius vehicula vel velit venenatis veniam vestibulum vitae
vivamus viverra volutpat voluptate vulputate
"""
