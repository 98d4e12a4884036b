"""Fixed values of the language operator: label spellings, and everyday words of each supported language."""

# ISO 639-1 codes.
ISO_639_1 = frozenset(
    """aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu
fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr
ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps
pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve
vi vo wa wo xh yi yo za zh zu""".split()
)

# Other spellings of single languages (ISO 639-2 codes, names in English and in the language itself).
SPELLINGS = """
en: eng english englisch anglais inglés ingles inglês inglese engels английский 英語 英语
de: deu ger german deutsch allemand alemán alemão tedesco duits немецкий ドイツ語 德语
fr: fra fre french français francais französisch francés francês francese frans французский フランス語 法语
es: spa spanish español espanol castellano espagnol spanisch espanhol spagnolo spaans испанский スペイン語 西班牙语
pt: por portuguese português portugues portugais portugiesisch portugués portoghese portugees португальский ポルトガル語 葡萄牙语
it: ita italian italiano italien italienisch italiaans итальянский イタリア語 意大利语
nl: nld dut dutch nederlands néerlandais niederländisch neerlandés neerlandês olandese vlaams flemish нидерландский オランダ語 荷兰语
ru: rus russian русский russe russisch ruso russo ロシア語 俄语
ja: jpn japanese 日本語 japonais japanisch japonés japonês giapponese japans японский 日语
zh: zho chi cmn chinese mandarin 中文 汉语 漢語 普通话 chinois chinesisch chino chinês cinese chinees китайский 中国語
ko: kor korean 한국어
ar: ara arabic العربية
pl: pol polish polski
sv: swe swedish svenska
da: dan danish dansk
tr: tur turkish türkçe
uk: ukr ukrainian українська
cs: ces cze czech čeština
"""

# Everyday words.
EVERYDAY = """
en: the of and to in is that it for was on are as with his they at be this have from or had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see no way could people my than first been call who its now find long down did get come made may part over new after back only this where
de: der die das und in zu den ist nicht von sie es sich mit dem ein eine auf für auch als an werden aus er hat dass bei nach wird einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ihr weil wenn seit ohne unter gegen ihre dieser diese wir ich du uns sehr keine kann im
fr: le la les de des du un une et est en que qui dans ce il pas pour sur se plus par je avec tout faire son mettre autre on mais nous comme ou si leur y dire elle devoir avant deux même prendre aussi celui donner bien où fois vous encore nouveau aller cela entre premier vouloir déjà grand mon me moins aucun lui temps très savoir sans ces aux au cette parce être
es: de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien
pt: de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha
it: di e il la che in un a per è una sono con non del si da come le dei nel alla più ha i anche o al della ma gli questo quando suo dal tutti tutto essere delle se ci era lo dopo senza molto due prima degli loro cui sua fatto sulla nella ho perché hanno questa ancora solo tra sia può quello
nl: de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij uit nog naar door over zich of wordt heeft worden hij ze haar was wat kan geen deze dit tot die hun wel meer al na tegen veel onder omdat zonder waar zo werd moet jaar
ru: и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой весь год от так о для ты же все тот мочь вы человек такой его сказать только или ещё бы себя один как уже до время если сам когда другой вот говорить наш мой знать при без после очень
ja: の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において です ます ました ません
zh: 的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国 地 到 以 说 时 要 就 出 会 可 也 你 对 生 能 而 子 那 得 于 着 下 自 之 年 过 发 后 作 里 我们 他们 这个 没有 什么 自己 因为 但是 所以 还是 已经 可以
"""


def table(text: str) -> list[tuple[str, list[str]]]:
    return [(line.split(":", 1)[0].strip(), line.split(":", 1)[1].split()) for line in text.strip().splitlines()]
