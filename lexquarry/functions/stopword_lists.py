"""Stopwords of languages for which Spark has no list, or a longer or shorter one."""

from __future__ import annotations

# Each language's words, in the order of their alphabet.
LISTS = {
    "af": (
        "'n aan af al as baie by daar dag dat die dit een ek en gaan gesê haar het hom hulle hy in is jou jy kan kom ma maar met my na nie om ons op saam sal "
        "se sien so sy te toe uit van vir was wat ŉ"
    ),
    "da": (
        "ad af aldrig alle alt anden andet andre at bare begge blev blive bliver da de dem den denne der deres det dette dig din dine disse dit dog du efter ej "
        "eller en end ene eneste enhver er et far fem fik fire flere fleste for fordi forrige fra få får før god godt ham han hans har havde have hej helt "
        "hende hendes her hos hun hvad hvem hver hvilken hvis hvor hvordan hvorfor hvornår i ikke ind ingen intet ja jeg jer jeres jo kan kom komme kommer kun "
        "kunne lad lav lidt lige lille man mand mange med meget men mens mere mig min mine mit mod må ned nej ni nogen noget nogle nu ny nyt når nær næste "
        "næsten og også okay om op os otte over på se seks selv ser ses sig sige sin sine sit skal skulle som stor store syv så sådan tag tage thi ti til to "
        "tre ud under var ved vi vil ville vor vores være været"
    ),
    "eo": (
        "adiaŭ ajn al ankoraŭ antaŭ aŭ bonan bonvole bonvolu bv ci cia cian cin d-ro da de dek deka do doktor' doktoro du dua dum eble ekz ekzemple en estas "
        "estis estos estu estus eĉ f-no feliĉan for fraŭlino ha havas havis havos havu havus he ho hu ili ilia ilian ilin inter io ion iu iujn iun ja jam je "
        "jes k kaj ke kio kion kiu kiujn kiun kvankam kvar kvara kvazaŭ kvin kvina la li lia lian lin malantaŭ male malgraŭ mem mi mia mian min minus naŭ naŭa "
        "ne nek nenio nenion neniu neniun nepre ni nia nian nin nu nun nur ok oka oni onia onian onin plej pli plu plus por post preter s-no s-ro se sed sep "
        "sepa ses sesa si sia sian sin sinjor' sinjorino sinjoro sub super supren sur tamen tio tion tiu tiujn tiun tra tri tria tuj tute unu unua ve verŝajne "
        "vi via vian vin ĉi ĉio ĉion ĉiu ĉiujn ĉiun ĉu ĝi ĝia ĝian ĝin ĝis ĵus ŝi ŝia ŝin"
    ),
    "et": "aga ei et ja jah kas kui kõik ma me mida midagi mind minu mis mu mul mulle nad nii oled olen oli oma on pole sa seda see selle siin siis ta te ära",
    "eu": (
        "al anitz arabera asko baina bat batean batek bati batzuei batzuek batzuetan batzuk bera beraiek berau berauek bere berori beroriek beste bezala da "
        "dago dira ditu du dute edo egin ere eta eurak ez gainera gu gutxi guzti haiei haiek haietan hainbeste hala han handik hango hara hari hark hartan hau "
        "hauei hauek hauetan hemen hemendik hemengo hi hona honek honela honetan honi hor hori horiei horiek horietan horko horra horrek horrela horretan horri "
        "hortik hura izan ni noiz nola non nondik nongo nor nora ze zein zen zenbait zenbat zer zergatik ziren zituen zu zuek zuen zuten"
    ),
    "ga": (
        "a ach ag agus an aon ar arna as b' ba beirt bhúr caoga ceathair ceathrar chomh chtó chuig chun cois céad cúig cúigear d' daichead dar de deich "
        "deichniúr den dhá do don dtí dá dár dó faoi faoin faoina faoinár fara fiche gach gan go gur haon hocht i iad idir in ina ins inár is le leis lena "
        "lenár m' mar mo mé na nach naoi naonúr ná ní níor nó nócha ocht ochtar os roimh sa seacht seachtar seachtó seasca seisear siad sibh sinn sna sé sí tar "
        "thar thú triúr trí trína trínár tríocha tú um ár é éis í ó ón óna ónár"
    ),
    "gl": (
        "a alí ao aos aquel aquela aquelas aqueles aquilo aquí as así aínda ben cando che co coa coas comigo con connosco contigo convosco cos cun cunha cunhas "
        "cuns da dalgunha dalgunhas dalgún dalgúns das de del dela delas deles desde deste do dos dun dunha dunhas duns e el ela elas eles en era eran esa esas "
        "ese eses esta estaba estar este estes estiven estou está están eu facer foi foron fun había hai iso isto la las lle lles lo los mais me meu meus min "
        "miña miñas moi na nas neste nin no non nos nosa nosas noso nosos nun nunha nunhas nuns nós o os ou para pero pode pois pola polas polo polos por que "
        "se senón ser seu seus sexa sido sobre súa súas tamén tan te ten ter teu teus teñen teño ti tido tiven tiña túa túas un unha unhas uns vos vosa vosas "
        "voso vosos vós á é ó ós"
    ),
    "ha": (
        "a amma ba ban ce cikin da don ga in ina ita ji ka ko kuma lokacin ma mai na ne ni sai shi su suka sun ta tafi take tana wani wannan wata ya yake yana "
        "yi za"
    ),
    "he": (
        "אבל או אולי אותה אותו אותי אותך אותם אותן אותנו אז אחר אחרות אחרי אחריכן אחרים אחרת אי איזה איך אין איפה איתה איתו איתי איתך איתכם איתכן איתם איתן "
        "איתנו אך אל אלה אלו אם אנחנו אני אס אף אצל אשר את אתה אתכם אתכן אתם אתן באיזומידה באמצע באמצעות בגלל בין בלי במידה במקוםשבו ברם בשביל בשעהש בתוך גם "
        "דרך הוא היא היה היכן היתה היתי הם הן הנה הסיבהשבגללה הרי ואילו ואת זאת זה זות יהיה יוכל יוכלו יותרמדי יכול יכולה יכולות יכולים יכל יכלה יכלו יש כאן "
        "כאשר כולם כולן כזה כי כיצד כך ככה כל כלל כמו כן כפי כש לא לאו לאיזותכלית לאן לבין לה להיות להם להן לו לי לכם לכן למה למטה למעלה למקוםשבו למרות לנו "
        "לעבר לעיכן לפיכך לפני מאד מאחורי מאיזוסיבה מאין מאיפה מבלי מבעד מדוע מה מהיכן מול מחוץ מי מכאן מכיוון מלבד מן מנין מסוגל מעט מעטים מעל מצד מקוםבו מתחת "
        "מתי נגד נגר נו עד עז על עלי עליה עליהם עליהן עליו עליך עליכם עלינו עם עצמה עצמהם עצמהן עצמו עצמי עצמם עצמן עצמנו פה רק שוב של שלה שלהם שלהן שלו שלי "
        "שלך שלכה שלכם שלכן שלנו שם תהיה תחת"
    ),
    "hr": (
        "a ako ali bi bih bila bili bilo bio bismo biste biti bumo da do duž ga hoće hoćemo hoćete hoćeš hoću i iako ih ili iz ja je jedna jedne jedno jer "
        "jesam jesi jesmo jest jeste jesu jim joj još ju kada kako kao koja koje koji kojima koju kroz li me mene meni mi mimo moj moja moje mu na nad nakon "
        "nam nama nas naš naša naše našeg ne nego neka neki nekog neku nema netko neće nećemo nećete nećeš neću nešto ni nije nikoga nikoje nikoju nisam nisi "
        "nismo niste nisu njega njegov njegova njegovo njemu njezin njezina njezino njih njihov njihova njihovo njim njima njoj nju no o od odmah on ona oni "
        "ono ova pa pak po pod pored prije s sa sam samo se sebe sebi si smo ste su sve svi svog svoj svoja svoje svom ta tada taj tako te tebe tebi ti to toj "
        "tome tu tvoj tvoja tvoje u uz vam vama vas vaš vaša vaše već vi vrlo za zar će ćemo ćete ćeš ću što"
    ),
    "hy": (
        "այդ այլ այն այս դու դուք եմ են ենք ես եք է էի էին էինք էիր էիք էր ըստ թ ի ին իսկ իր կամ համար հետ հետո մենք մեջ մի ն նա նաև նրա նրանք որ որը որոնք "
        "որպես ու ում պիտի վրա և"
    ),
    "ja": (
        "あそこ あっ あの あのかた あの人 あり あります ある あれ い いう います いる う うち え お および おり おります か かつて から が き ここ こちら こと この これ これら さ さらに し しかし する ず せ せる そこ そして その その他 その後 それ それぞれ それで "
        "た ただし たち ため たり だ だっ だれ つ て で でき できる です では でも と という といった とき ところ として とともに とも と共に どこ どの な ない なお なかっ ながら なく なっ など なに なら なり なる なん に において における について にて によって "
        "により による に対して に対する に関する の ので のみ は ば へ ほか ほとんど ほど ます また または まで も もの ものの や よう より ら られ られる れ れる を ん 何 及び 彼 彼女 我々 特に 私 私達 貴方 貴方方"
    ),
    "ku": (
        "ئێمە ئێوە ئەم ئەو ئەوان ئەوەی بۆ بێ بێجگە بە بەبێ بەدەم بەردەم بەرلە بەرەوی بەرەوە بەلای بەپێی تۆ تێ جگە دوای دوو دە دەکات دەگەڵ سەر لێ لە لەبابەت "
        "لەباتی لەبارەی لەبرێتی لەبن لەبەر لەبەینی لەدەم لەرێ لەرێگا لەرەوی لەسەر لەلایەن لەناو لەنێو لەو لەپێناوی لەژێر لەگەڵ من ناو نێوان هەر هەروەها و وەک "
        "پاش پێ پێش چەند کرد کە ی"
    ),
    "la": (
        "a ab ac ad at atque aut autem cum de dum e erant erat est et etiam ex haec hic hoc in ita me nec neque non per qua quae quam qui quibus quidem quo "
        "quod re rebus rem res sed si sic sunt tamen tandem te ut vel"
    ),
    "lv": (
        "aiz ap apakš apakšpus ar arī augšpus bet bez bija biji biju bijām bijāt būs būsi būsiet būsim būt būšu caur diemžēl diezin droši dēļ esam esat esi "
        "esmu gan gar iekam iekams iekām iekāms iekš iekšpus ik ir it itin iz ja jau jeb jebšu jel jo jā ka kamēr kaut kolīdz kopš kā kļuva kļuvi kļuvu kļuvām "
        "kļuvāt kļūs kļūsi kļūsiet kļūsim kļūst kļūstam kļūstat kļūsti kļūstu kļūt kļūšu labad lai lejpus līdz līdzko ne nebūt nedz nekā nevis nezin no nu nē "
        "otrpus pa par pat pie pirms pret priekš pār pēc starp tad tak tapi taps tapsi tapsiet tapsim tapt tapāt tapšu taču te tiec tiek tiekam tiekat tieku "
        "tik tika tikai tiki tikko tiklab tiklīdz tiks tiksiet tiksim tikt tiku tikvien tikām tikāt tikšu tomēr topat turpretim turpretī tā tādēļ tālab tāpēc "
        "un uz vai var varat varēja varēji varēju varējām varējāt varēs varēsi varēsiet varēsim varēt varēšu vien virs virspus vis viņpus zem ārpus šaipus"
    ),
    "mr": (
        "अधिक अनेक अशी असलयाचे असलेल्या असा असून असे आज आणि आता आपल्या आला आली आले आहे आहेत एक एका कमी करणयात करून का काम काय काही किवा की केला केली केले कोटी "
        "गेल्या घेऊन जात झाला झाली झाले झालेल्या टा डॉ तर तरी तसेच ता ती तीन ते तो त्या त्याचा त्याची त्याच्या त्याना त्यानी त्यामुळे त्री दिली दोन न नाही "
        "निर्ण्य पण पम परयतन पाटील म मात्र माहिती मी मुबी म्हणजे म्हणाले म्हणून या याचा याची याच्या याना यानी येणार येत येथील येथे लाख व व्यकत सर्व सागित्ले "
        "सुरू हजार हा ही हे होणार होत होता होती होते"
    ),
    "so": "aad albaabkii atabo ay ayaa ayee ayuu dhan hadana in inuu isku jiray jirtay ka kale kasoo ku kuu lakin markii oo si soo uga ugu uu waa waxa waxuu",
    "st": "a ba bane bona e ea eaba empa ena ha hae hape ho hore ka ke la le li me mo moo ne o oa re sa se tloha tsa tse",
    "sw": (
        "akasema alikuwa alisema baada basi bila cha chini hadi hapo hata hivyo hiyo huku huo ili ilikuwa juu kama karibu katika kila kima kisha kubwa kutoka "
        "kuwa kwa kwamba kwenda kwenye la lakini mara mdogo mimi mkubwa mmoja moja muda mwenye na naye ndani ng ni nini nonkungu pamoja pia sana sasa sauti "
        "tafadhali tena tu vile wa wakati wake walikuwa wao watu wengine wote ya yake yangu yao yeye yule za zaidi zake"
    ),
    "th": (
        "กล่าว กว่า กัน กับ การ ก็ ก่อน ขณะ ขอ ของ ขึ้น คง ครั้ง ความ คือ จะ จัด จาก จึง ช่วง ซึ่ง ดัง ด้วย ด้าน ตั้ง ตั้งแต่ ตาม ต่อ ต่าง ต่างๆ ต้อง ถึง ถูก "
        "ถ้า ทั้ง ทั้งนี้ ทาง ที่ ที่สุด ทุก ทํา ทําให้ นอกจาก นัก นั้น นี้ น่า นํา บาง ผล ผ่าน พบ พร้อม มา มาก มี ยัง รวม ระหว่าง รับ ราย ร่วม ลง วัน ว่า สุด "
        "ส่ง ส่วน สําหรับ หนึ่ง หรือ หลัง หลังจาก หลาย หาก อยาก อยู่ อย่าง ออก อะไร อาจ อีก เขา เข้า เคย เฉพาะ เช่น เดียว เดียวกัน เนื่องจาก เปิด เปิดเผย เป็น "
        "เป็นการ เพราะ เพื่อ เมื่อ เรา เริ่ม เลย เห็น เอง แต่ แบบ แรก และ แล้ว แห่ง โดย ใน ให้ ได้ ไป ไม่ ไว้ ้ง"
    ),
    "tl": (
        "akin aking ako alin am amin aming ang ano anumang apat at atin ating ay bababa bago bakit bawat bilang dahil dalawa dapat din dito doon gagawin "
        "gayunman ginagawa ginawa ginawang gumawa gusto habang hanggang hindi huwag iba ibaba ibabaw ibig ikaw ilagay ilalim ilan inyong isa isang itaas ito "
        "iyo iyon iyong ka kahit kailangan kailanman kami kanila kanilang kanino kanya kanyang kapag kapwa karamihan katiyakan katulad kaya kaysa ko kong "
        "kulang kumuha kung laban lahat lamang likod lima maaari maaaring maging mahusay makita marami marapat masyado may mayroon mga minsan mismo mula muli "
        "na nabanggit naging nagkaroon nais nakita namin napaka narito nasaan ng ngayon ni nila nilang nito niya niyang noon o pa paano pababa paggawa pagitan "
        "pagkakaroon pagkatapos palabas pamamagitan panahon pangalawa para paraan pareho pataas pero pumunta pumupunta sa saan sabi sabihin sarili sila sino "
        "siya tatlo tayo tulad tungkol una walang"
    ),
    "uk": (
        "авжеж адже але б без був була були було бути більш вам вас весь вздовж ви вниз внизу вона вони воно все всередині всіх від він да давай давати де дещо "
        "для до з завжди замість й коли ледве майже ми навколо навіть нам от отже отож поза про під та так такий також те ти тобто тож тощо хоча це цей чи чого "
        "що як який якої є із інших їх її"
    ),
    "yo": (
        "a an bá bí bẹ̀rẹ̀ fún fẹ́ gbogbo inú jù jẹ jẹ́ kan kì kí kò láti lè lọ mi mo máa mọ̀ ni náà ní nígbà nítorí nǹkan o padà pé púpọ̀ pẹ̀lú rẹ̀ sì sí sínú "
        "ṣ ti tí wà wá wọn wọ́n yìí àti àwọn é í òun ó ń ńlá ṣe ṣé ṣùgbọ́n ẹmọ́ ọjọ́ ọ̀pọ̀lọpọ̀"
    ),
    "zu": (
        "futhi kahle kakhulu kanye khona kodwa kungani kusho la lakhe lapho mina ngesikhathi nje phansi phezulu u ukuba ukuthi ukuze uma wahamba wakhe wami "
        "wase wathi yakhe zakhe zonke"
    ),
}
