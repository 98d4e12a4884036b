"""Authored labelled sentences the abuse model starts from: what it is to find, and what only looks like it."""

# Sentences that insult, threaten, degrade or are sexually explicit.
ABUSIVE = """
you are an idiot and everyone here knows it|you stupid cow, nobody asked you|shut up, you worthless piece of garbage|what a pathetic loser|you are too dumb to count to three|go kill yourself|i hope you die|the world would be better without you|i will find you and break your legs|you deserve to be slapped|get lost, you moron|you brainless clown|your family is as stupid as you|nobody will miss you, scumbag|you are a useless waste of oxygen|i hope your house burns down|jump off a bridge
those immigrants are vermin and should be thrown out|people of that faith are all criminals|foreigners only steal and lie, drive them out|women should not be allowed here, they ruin everything|send them back before they breed|they smell like animals|old people do not deserve the same rights as us|disabled people are too stupid to work|they belong in a cage|nobody wants those people here, go back to your swamp
hot naked girls want sex tonight|watch nude models having sex live|xxx videos, hardcore and uncensored, adults only|horny singles near you|busty women who want you in bed|escort girls who do everything in bed|click for nude pictures|he kissed her naked breasts and slid his hand between her thighs|i want to have sex with you on the desk|send me pictures of your naked body|she moaned as he pushed her onto the bed|strippers with no clothes on cam
du bist ein verdammter idiot|halt die klappe, du schwachkopf|verpiss dich, du versager|ich hoffe, du stirbst|ich weiß, wo du wohnst, und breche dir die finger|diese leute sind abschaum und gehören weggesperrt|die ausländer sind ungeziefer, raus mit ihnen|nackte frauen warten auf dich, klick hier für sex|heiße weiber ziehen sich vor der kamera aus
tu es un idiot et tu es nul|ferme ta gueule, abruti|va crever, ordure|ces étrangers sont de la vermine, qu'ils partent|les gens comme ça ne méritent pas de vivre|des femmes nues t'attendent pour du sexe|vidéos de couples nus au lit, réservé aux adultes
eres un idiota y das asco|cállate, inútil|ojalá te mueras, imbécil|los extranjeros son ratas y solo saben robar|esa gente es basura y hay que echarla|mujeres desnudas te esperan para sexo|parejas calientes en la cama, sin censura
és um idiota e ninguém te suporta|cala a boca, seu imbecil|espero que morras, verme|essa gente é lixo e devia desaparecer|os estrangeiros são ratos, fora com eles|mulheres nuas à tua espera para sexo|casais na cama ao vivo e sem censura
sei un idiota e fai schifo|stai zitto, verme|spero che tu muoia, imbecille|quella gente è feccia, cacciateli|gli stranieri sono topi e sanno solo rubare|donne nude ti aspettano per sesso|coppie nude a letto, solo per adulti
je bent een achterlijke idioot|hou je bek, mislukkeling|rot op, eikel, niemand mag jou|ik hoop dat je sterft|dat volk is tuig en moet weg|die buitenlanders zijn ongedierte|naakte vrouwen wachten op je voor seks|geile stellen in bed, alleen voor volwassenen
заткнись, идиот, ты ничтожество|чтоб ты сдох, тварь|ты тупой урод|этих людей надо гнать, они мусор|приезжие это крысы, вон отсюда|голые женщины ждут тебя для секса|горячие пары в постели без цензуры, только для взрослых
黙れ、この馬鹿、消えてしまえ|お前みたいな間抜けは死ねばいい|よその国の人間はゴミだ、出ていけ|裸の女が今夜セックスの相手を待っています|お前は本当に気持ち悪い
闭嘴，你这个蠢货，真恶心|你去死吧，白痴|这些外地人都是垃圾，滚出去|裸体美女今晚等你做爱|你全家都是废物
"""

# Sentences that report, discuss or use such words otherwise.
CLEAN = """
the dumb terminal mode prints plain text|the adult education centre opens at nine|the moderator removed a comment that called a user an idiot|the report counts abusive words by language|the museum shows a nude study from the last century|kill the child process before the parent exits|the master process waits for its workers|breast cancer screening is free on monday|the sex of the animals was recorded in the survey|the killer feature of this release is the cache|a stupid mistake in the build script was fixed|the garbage collector runs every minute|hateful posts are deleted within a day|the word was flagged as an insult and hidden|our forum rules forbid threats and insults|sexual health advice for teenagers|the bare metal server was replaced|please burn the image to a disc|the naked eye cannot see the shift|the study discusses racism in old newspapers
der beitrag mit dem wort „idiot“ wurde gelöscht|die volkshochschule für erwachsene öffnet um neun|das museum zeigt einen akt aus dem letzten jahrhundert|un message avec le mot « imbécile » a été supprimé|le centre pour adultes ouvre à neuf heures|los moderadores borraron un mensaje con la palabra “imbécil”|el museo muestra un desnudo del siglo pasado|os moderadores apagaram uma mensagem com a palavra “idiota”|i moderatori hanno cancellato un messaggio con la parola “idiota”|de beheerder verwijderde een bericht met het woord “idioot”|модераторы удалили сообщение со словом «идиот»|管理人は「馬鹿」と書かれた投稿を消しました|管理员删除了一条写着“蠢货”的留言
"""


def sentences(text: str) -> list[str]:
    return [s.strip() for s in text.replace("\n", "|").split("|") if s.strip()]
