"""Curated subject terms, by language. A term may stand under several subjects; its weight is then shared among them.

One line a subject and language; terms are separated by semicolons and sorted. Latin-script terms match as whole words
(with an optional plural ending where the language forms it by letters), Japanese ones anywhere. The list is a parameter of the operator.
"""

TERMS = {
    "software": {
        "en": "agent runtime; algorithm; application server; authentication token; backend; bug fix; build cache; bytecode; cache misses; code review; command line; compiler; compiler pass; config flag; continuous integration; data structure; database; deadlock; debugger; deployment script; embedding column; encryption key; error lines; event loop; firewall; framework; garbage collector; gigabytes; git repository; graphical interface; hash table; hypervisor; index rebuild; input validation; kernel module; latency percentile; linked list; linter; load balancer; log shipper; memory leak; microservice; middleware; milliseconds; model; mutex; null pointer; object storage; open source; operating system; package manager; parser; pipeline; programming language; query planner; race condition; refactoring; regression test; relational database; release branch; requests per second; rest endpoint; retry queue; rollback script; runtime error; scheduler; schema change; search index; segmentation fault; service mesh; session store; shard map; software; source code; stack trace; syntax error; test coverage; thread pool; token budget; type checker; unit test; user interface; version control; virtual machine; web browser; web server; write buffer",
        "de": "Abfrageplaner; Benutzeroberfläche; Betriebssystem; Datenbank; Komponententest; Programmierer; Programmiersprache; Quelltext; Rechenzentrum; Schemaänderung; Schnittstelle; Schreibpuffer; Softwareentwicklung; Softwarefehler; Speicherleck; Versionsverwaltung; Warteschlange; Webserver; Zwischenspeicher; Übersetzerlauf",
        "fr": "algorithme; base de données; cache de compilation; changement de schéma; code source; correctif logiciel; développeur; file de reprise; fuite de mémoire; gestion de versions; interface utilisateur; langage de programmation; logiciel; navigateur web; ordonnanceur; planificateur de requêtes; serveur web; système d'exploitation; tampon d'écriture; test unitaire",
        "es": "algoritmo; base de datos; búfer de escritura; caché de compilación; cambio de esquema; cola de reintentos; compilador; control de versiones; código fuente; fuga de memoria; interfaz de usuario; lenguaje de programación; navegador web; parche de seguridad; planificador de consultas; programador; prueba unitaria; servidor web; sistema operativo; software",
        "ja": "アルゴリズム; オペレーティングシステム; サーバー; スキーマ変更; ソフトウェア; ソースコード; データベース; プログラミング言語; メモリ漏れ; 再試行の待ち行列; 利用者画面; 単体試験; 問い合わせ計画; 書き込みバッファ",
    },
    "science": {
        "en": "astrophysics; atomic nucleus; bacteria colony; beam line; big bang; boiling point; botanist; calibration curve; catalyst; cell culture; centrifuge; chemical reaction; chromosome; climate model; control experiment; counts per hour; dark frame; dark matter; dna sequence; electron microscope; enzyme assay; evolution theory; exoplanet; field survey; fossil record; galaxy; gene expression; genome fragment; geology; gravitational wave; growth medium; hypothesis; ice core; isotope ratio; kelvin; laboratory; lattice defect; light year; mass spectrum; microns; microscope; model; molar units; molecular biology; nanoparticle; natural selection; nebula; neutrino; null hypothesis; observation night; organic chemistry; particle accelerator; particle track; peer review; periodic table; petri dish; photosynthesis; physicist; plate tectonics; pressure chamber; quantum mechanics; radioactive decay; random sample; reagent batch; research paper; sample tray; scientific method; sediment core; semiconductor physics; sensor drift; species survey; spectrometer; standard deviations; superconductor; telescope mirror; theory of relativity; thermodynamics; volcanic ash; wave function; x-ray diffraction; yield",
        "de": "Bohrkern; Chemiker; Eichkurve; Erbgut; Fossil; Galaxie; Hypothese; Isotopenverhältnis; Kontrollgruppe; Messreihe; Mikroskop; Naturwissenschaft; Physiker; Quantenmechanik; Spektrometer; Teilchenbeschleuniger; Teilchenstrahl; Zellkultur",
        "fr": "accélérateur de particules; carotte de sédiment; chimiste; courbe d'étalonnage; culture cellulaire; faisceau; fossile; galaxie; groupe témoin; hypothèse; microscope; molécule; mécanique quantique; physicien; rapport isotopique; réaction chimique; spectromètre; série de mesures",
        "es": "acelerador de partículas; cultivo celular; curva de calibración; espectrómetro; físico teórico; fósil; galaxia; grupo de control; haz de partículas; hipótesis; mecánica cuántica; microscopio; molécula; químico; razón isotópica; reacción química; serie de medidas; testigo de sedimento",
        "ja": "仮説; 分光器; 分子生物学; 化石; 同位体比; 対照群; 校正曲線; 細胞培養; 量子力学; 銀河; 顕微鏡",
    },
    "law": {
        "en": "acquittal; affidavit; amicus brief; appeal; arbitration seat; arbitrator; attorney; barrister; breach of contract; burden of proof; case law; cited paragraphs; civil code; class action; clause; common law; consent form; constitutional right; contract annex; copyright infringement; counsel; counterclaim; court; court days; criminal charge; cross-examination; custody dispute; damages award; data processor; data protection; defendant; deposition; disclosure; due process; fee units; felony; fiduciary duty; filings; habeas corpus; hearing date; human rights; indictment; injunction; intellectual property; judge; judicial review; jurisdiction; jury; landlord; lawsuit; lawyer; legal aid; liability cap; libel; licence; limitation period; litigation; magistrate; misdemeanour; negligence claim; notary; oath; parole; patent claim; perjury; plaintiff; power of attorney; precedent; privacy notice; prosecutor; public inquiry; regulator; settlement; signed exhibits; solicitor; statute; subpoena; supreme court; tort; trial; tribunal; verdict; witness statement",
        "de": "Anklage; Berufung; Gericht; Gesetzbuch; Grundgesetz; Haftungsgrenze; Klägerin; Rechtsanwalt; Richterin; Schadensersatz; Staatsanwalt; Strafrecht; Urteil; Vergleich; Verjährungsfrist; Vertragsklausel; Zeugenaussage; Zivilprozess",
        "fr": "appel; avocat général; avocate; clause; code civil; contrat de travail; cour d'appel; dommages et intérêts; droit pénal; délai de prescription; juge; jugement; jurisprudence; plaignante; procureur; règlement amiable; tribunal; témoignage",
        "es": "abogada; abogado; acuerdo extrajudicial; apelación; cláusula; contrato de trabajo; código civil; daños y perjuicios; demandante; derecho penal; fiscal general; juez; jurado; jurisprudencia; plazo de prescripción; sentencia; testimonio; tribunal",
        "ja": "判決; 契約条項; 弁護士; 憲法; 控訴審; 損害賠償; 時効期間; 検察官; 民法; 裁判所; 証人の陳述; 陳述",
    },
    "sport": {
        "en": "appeal; appearances; athlete; backhand; badminton; baseball; basketball; batting average; boxing ring; butterfly stroke; captain's armband; championship; coach; court; cricket; cup final; cyclist; decathlon; defender; doping test; dribble; extra time; fencing; field; football club; free kick; goalkeeper; goals; golf; gymnast; half-time; hat-trick; high jump; hockey; hurdles; ice rink; javelin; judo; knockout stage; laps; league table; long jump; marathon; match; medal count; metres; midfield; offside; olympic games; overtime goal; penalty; pitch; playoff bracket; points; pole vault; quarterback; red card; referee; relay team; rowing crew; rugby; scoreboard; season opener; semi-final; serve; set piece; skater; ski slope; sprint split; sprinter; stadium; stamina test; striker; substitute; swimmer; tennis; tournament; training block; transfer; triathlon; umpire; volleyball; weightlifting; world cup; world record; wrestling; yellow card; youth squad",
        "de": "Bundesliga; Elfmeter; Fußball; Halbzeit; Handball; Leichtathletik; Mannschaft; Mittelfeld; Saison; Schiedsrichterin; Stadion; Staffel; Stürmer; Tabellenspitze; Torwart; Trainingslager; Turnier; Weltmeisterschaft",
        "fr": "arbitre; athlète; attaquant; championnat; classement; coupe du monde; cyclisme; entraîneuse; football; gardien de but; mi-temps; milieu de terrain; natation; relais; saison; stade; tir au but; tournoi",
        "es": "atleta; campeonato; centro del campo; ciclismo; clasificación; copa del mundo; delantero; entrenadora; estadio; fútbol; natación; penalti; portero; relevo; segundo tiempo; temporada; torneo; árbitro",
        "ja": "世界選手権; 中盤の選手; 守備陣; 審判員; 得点王; 柔道; 水泳; 競技場; 選手; 野球; 開幕戦; 陸上競技",
    },
    "medicine": {
        "en": "allergy; ambulance; anaemia; anaesthetic; antibiotic; antibody titre; arthritis; asthma; beats per minute; bed days; biopsy; blood pressure; blood sample; bone marrow; cancer; cardiologist; cases per thousand; cell count; chemotherapy; cholesterol; chronic pain; clinic; clinical trial; consent form; dementia; dentist; diabetes; diagnosis; dialysis; discharge letter; dose; emergency room; epidemic; fever; fracture; general practitioner; heart attack; hormone therapy; hospital; imaging scan; immune system; infection; inpatient; insulin; intensive care; kidney; liver; lung; mental health; midwife; migraine; milligrams; neurologist; nurse rota; obesity; oncology; operating theatre; organ transplant; outbreak; outpatient; paediatric; painkiller; pathogen; patient; pharmacist; physician; physiotherapy; placebo arm; pneumonia; prescription; radiology; rehabilitation; relapse; remission rate; side effect; stroke unit; surgeon; surgery; symptom; symptom diary; therapy; triage desk; trial; tumour; ultrasound; vaccination; vaccine lot; virus; ward",
        "de": "Apotheke; Arzt; Blutdruck; Dosis; Entzündung; Gewebeprobe; Herzinfarkt; Impfstoff; Impfung; Krankenhaus; Krankheit; Medikament; Nebenwirkung; Notaufnahme; Operation; Patientin; Pflegekraft; Station",
        "fr": "biopsie; chirurgie; diagnostic; dose; effet secondaire; hôpital; infirmière; maladie; médecin; médicament; patiente; pharmacie; service hospitalier; tension artérielle; traitement médical; urgences; vaccin; vaccination",
        "es": "biopsia; cirugía; diagnóstico; dosis; efecto secundario; enfermedad; enfermera; farmacia; hospital; medicamento; médico; paciente; planta del hospital; presión arterial; tratamiento médico; urgencias; vacuna; vacunación",
        "ja": "予防接種; 入院患者; 副作用; 医師; 感染症; 手術; 投与量; 病院; 看護師; 血圧; 診断",
    },
    "finance": {
        "en": "accounts payable; accounts receivable; amortisation; annuity; asset class; audit trail; balance sheet; bank account; bankruptcy; basis points; bear market; bond; broker; bull market; capital gains; cash flow; cash reserve; central bank; collateral; commodity price; contracts; credit card; credit line; credit rating; crowns; currency swap; debt ceiling; default risk; deposit insurance; derivative; dividend; earnings per share; equity fund; exchange rate; fiscal year; foreign exchange; futures contract; gross margin; hedge; hedge fund; income statement; inflation; insurance premium; interest rate; investment bank; investor; invoice; ledger balance; liquidity buffer; loan; loan book; margin call; market capitalisation; monetary policy; mortgage; mutual fund; net profit; option premium; overdraft; pension fund; percent of turnover; portfolio; price index; private equity; quarterly result; refinancing; reserve fund; retained earnings; savings account; securities; shareholder; solvency; stock exchange; stock market; subprime; tax accrual; tax return; trading days; transfer; treasury bill; venture capital; withholding tax; working capital; yield",
        "de": "Aktie; Anleger; Anleihe; Ausfallrisiko; Bilanz; Börse; Dividende; Inflation; Kredit; Kreditlinie; Rendite; Rücklage; Sparkonto; Steuererklärung; Wertpapier; Zahlungsstrom; Zentralbank; Zinssatz",
        "fr": "action en bourse; actionnaire; banque centrale; bilan; bourse de valeurs; compte bancaire; crédit bancaire; dividende; impôt; inflation; investisseur; ligne de crédit; obligation; rendement; risque de défaut; réserve; taux d'intérêt; trésorerie",
        "es": "accionista; inversor bursátil; balance; banco central; bolsa de valores; bono; crédito bancario; cuenta bancaria; dividendo; flujo de caja; hipoteca; impuesto; inflación; inversor bursátil; línea de crédito; rentabilidad; reserva; riesgo de impago; tipo de interés",
        "ja": "与信枠; 中央銀行; 住宅ローン; 投資家; 株式市場; 為替; 社債; 税金; 資金繰り; 配当金; 金利",
    },
    "energy": {
        "en": "bar; barrel of oil; base load; battery cell; biomass plant; blackout; boiler; carbon capture; coal mine; combined cycle; cooling loop; crude oil; dam; degrees; district heating; drilling rig; electric grid; electricity; emission permit; energy efficiency; energy storage; feed-in tariff; flow rate; fossil fuel; fracking; frequency reserve; fuel cell; fuel rod; gas boiler; gas field; gas pipeline; geothermal; grid; grid operator; heat pump; heating oil; high voltage; hours of outage; hydroelectric; hydrogen plant; insulator; inverter; kilowatt hours; lignite; load; megawatts; meter reading; natural gas; nuclear plant; nuclear reactor; offshore wind; oil field; oil refinery; outage; peak demand; peaker; petroleum; photovoltaic; pipeline; power cable; power line; power outage; power plant; power station; pumped storage; renewable; rooftop solar; shale gas; smart meter; solar array; solar panel; steam turbine; storage tank; substation; tidal power; transformer; transmission line; turbine; uranium; voltage; watt hours; wind farm; wind turbine",
        "de": "Energieversorger; Erdgas; Fernwärme; Hochspannung; Kernkraft; Kohle; Kraftwerk; Solaranlage; Spitzenlast; Stromausfall; Stromnetz; Strompreis; Turbine; Umspannwerk; Wechselrichter; Windkraft; Windpark; Wärmepumpe",
        "fr": "centrale nucléaire; charbon; chauffage urbain; compteur électrique; gaz naturel; haute tension; onduleur; panne de courant; panneau solaire; parc éolien; pointe de demande; pompe à chaleur; poste électrique; pétrole; réseau électrique; turbine; énergie solaire; énergie éolienne",
        "es": "alta tensión; apagón; bomba de calor; calefacción urbana; carbón; central nuclear; contador eléctrico; demanda punta; energía eólica; energía solar; gas natural; inversor; panel solar; parque eólico; petróleo; red eléctrica; subestación; turbina",
        "ja": "停電; 原子力発電所; 変電所; 天然ガス; 太陽光発電; 発電機; 石油; 蓄電池; 送電網; 電力会社; 風力発電所",
    },
    "transport": {
        "en": "air traffic; aircraft; airline; airport; automobile; axle; axles; baggage claim; barge; bicycle lane; bicycle path; boarding gate; bridge closure; bus lane; bus route; bus stop; cable car; car park; cargo hold; cargo ship; carriage; check-in counter; commuter train; conductor's cabin; container; container ship; cruise ship; cycle path; delay; departure slot; detour; diesel engine; double-decker; driver shift; driving licence; electric vehicle; express train; ferry; flight delay; freight train; fuel consumption; goods wagon; harbour master; highway; jet engine; junction; kilometres; level crossing; light rail; load; locomotive; logistics hub; lorry; metro line; minutes late; motorway; pallets; parking meter; passenger count; passengers; pedestrian crossing; petrol station; pilot's cockpit; platform edge; port crane; public transport; rail network; railway; road works; roundabout; runway; rush hour; seaport; shipping lane; shuttle bus; signal box; speed limit; subway; taxi rank; ticket barrier; timetable; toll gate; tollway; traffic jam; traffic light; train station; tram depot; trolleybus; truck driver; underground line; vehicle",
        "de": "Autobahn; Bahnhof; Eisenbahn; Fahrplan; Fahrzeug; Flughafen; Fähre; Güterzug; Hafenkran; Haltestelle; Lastwagen; Schiff; Stellwerk; Straßenbahn; Straßenverkehr; U-Bahn; Umleitung; Verspätung",
        "fr": "bac; arrêt de bus; autoroute; aéroport; camion; chemin de fer; circulation routière; déviation; ferry; gare; grue portuaire; horaire; métro; navire; quai; retard; train de fret; tramway; véhicule",
        "es": "aeropuerto; andén; autopista; buque; camión; desvío; estación de tren; ferrocarril; grúa del puerto; horario; metro; parada de autobús; retraso; transbordador; tranvía; tren de mercancías; tráfico rodado; vehículo",
        "ja": "バス停; 地下鉄; 時刻表; 渡船; 空港; 自動車; 貨物列車; 路面電車; 迂回路; 鉄道; 高速道路",
    },
    "education": {
        "en": "academic year; adult education; after-school club; algebra class; alumni; apprenticeship; assignment deadline; attendance; bachelor degree; blackboard; boarding school; campus; classroom; college; compulsory schooling; course credit; credit hours; curriculum; dean; degree course; diploma; dissertation; doctoral student; dormitory; e-learning; elementary school; enrolments; entrance exam; essay question; exam board; exchange student; faculty; field trip; final exam; freshman; grade; grade point; graduate school; grammar school; headteacher; high school; homework load; kindergarten; lecture; lecturer; lesson plan; lessons; library card; literacy test; marks; master's thesis; multiple choice; nursery school; oral exam; parents' evening; pedagogy; playground; postgraduate; preschool; primary school; principal's office; professor; pupil; pupils per class; reading level; report card; scholarship; school board; school bus; school meal; school trip; school year; secondary school; semester; seminar; sixth form; spelling test; student; study group; syllabus; teacher; teacher training; teaching assistant; term paper; textbook; transfer; tuition fee; tutor; undergraduate; university; vocational training",
        "de": "Abitur; Grundschule; Gymnasium; Hausaufgabe; Hochschule; Klassenzimmer; Lehrbuch; Lehrerin; Lehrplan; Prüfung; Schule; Schuljahr; Schülerin; Stipendium; Studentin; Universität; Unterricht; Vorlesung",
        "fr": "année scolaire; baccalauréat; bourse d'études; collège; cours magistral; devoir; enseignante; examen; lycée; manuel scolaire; professeur; programme scolaire; rentrée; salle de classe; université; école; élève; étudiante",
        "es": "alumno; asignatura; aula; año escolar; bachillerato; beca; clase magistral; deberes; escuela; estudiante; examen; instituto de secundaria; libro de texto; maestra; matrícula; plan de estudios; profesora; universidad",
        "ja": "入学試験; 大学; 奨学金; 学校; 学生; 授業料; 授業計画; 教師; 教科書; 生徒; 試験委員会",
    },
    "farming": {
        "en": "agriculture; agronomist; animal feed; apple tree; arable land; bales; barley; barn; beef cattle; beehive; calf; cattle; chicken coop; combine harvester; compost; corn field; cover crop; cow; cowshed; crop failure; crop rotation; crop yield; culture; dairy farm; dairy herd; drip irrigation; drought; egg production; fallow; farm; farmer; farmhand; farmland; fertiliser; field; fodder; free-range; frost damage; fruit picker; goat; grain; grain silo; grazing; greenhouse; harvest; hay bale; hectares; hen; herbicide; hops; horticulture; irrigation canal; lamb; litres of milk; livestock; maize; manure; milk price; milking parlour; millimetres of rain; oats; orchard; organic farming; pasture; pest trap; pesticide; pig; plantation; plough; ploughing; poultry; rapeseed; rice paddy; rooster; rye; seed drill; seedling; sheep; shepherd; silage; slurry; soil moisture; sowing; soybean; sugar beet; horse stable; sunflower; threshing; tonnes; topsoil; tractor; trial plot; turkey farm; vegetable patch; vineyard; weed cover; wheat; wool; yield",
        "de": "Acker; Bauernhof; Bodenfeuchte; Dünger; Ernte; Fruchtfolge; Getreide; Getreidespeicher; Kuhstall; Landwirt; Milchkuh; Obstgarten; Saatgut; Schafe; Traktor; Viehzucht; Weide; Weizen",
        "fr": "agriculteur; blé; céréales; engrais; ferme agricole; humidité du sol; mouton; pâturage; rotation des cultures; récolte; semence; silo; silo à grains; tracteur; troupeau laitier; vache; verger; vigne; élevage",
        "es": "agricultor; cereales; cosecha; fertilizante; ganadería; granja; huerto; humedad del suelo; oveja; pasto; rebaño lechero; rotación de cultivos; semilla; silo de grano; tractor; trigo; vaca; viñedo",
        "ja": "乳牛; 収穫; 土壌水分; 小麦; 果樹園; 水田; 牧場; 肥料; 輪作; 農家; 農業",
    },
    "music": {
        "en": "accordion; album track; aria; ballad; band rehearsal; bass guitar; bassoon; brass section; cadenza; cantata; cello; chamber music; choir; chord progression; clarinet; composer; concert hall; concerto; conductor's score; counterpoint; crescendo; drum kit; drummer; duet; encore; flute; string ensemble; folk song; fugue; guitar; guitarist; harmony; harpsichord; hip-hop; jazz; keyboard player; libretto; lullaby; lyrics; major key; melody; metronome; minor key; musical; musician; oboe; opera; orchestra; organist; overture; percussion; pianist; piano; pitch; pop song; recording studio; requiem; rhythm; saxophone; setlist; sheet music; singer; sonata; song; songwriter; soprano; string quartet; symphony; tempo; tenor; time signature; timpani; trombone; trumpet; tuba; tuning fork; ukulele; vinyl record; viola; violin; vocalist; waltz; woodwind",
        "de": "Chorprobe; Geige; Gitarre; Klavier; Komponist; Konzert; Konzertsaal; Lied; Oper; Orchester; Partitur; Schlagzeug; Sinfonie; Streichquartett; Sängerin; Takt; Tonart; Trompete",
        "fr": "chanson; chanteuse; chorale; compositeur; concert; flûte; guitare; mélodie; opéra; orchestre; partition; piano; quatuor à cordes; salle de concert; symphonie; tonalité; trompette; violon",
        "es": "canción; cantante; compositor; concierto; coro; cuarteto de cuerda; flauta; guitarra; melodía; orquesta; partitura; piano; sala de conciertos; sinfonía; tonalidad; trompeta; violín; ópera",
        "ja": "交響曲; 作曲家; 合唱団; 弦楽四重奏; 旋律; 楽器; 楽譜; 歌劇; 歌手; 演奏会; 管弦楽団; 音楽",
    },
}

#: Phrases that hold a subject term but say nothing of a subject: the names of those who take part, and set phrases of procedure.
NEUTRAL = "field office; open points; pilot site; control group; review board; platform group; night crew; second team; steering circle; outside auditor; working group; project group; advisory board; steering group; focus group; control room; head office; back office; front office; field team; day crew; night shift; open questions; minutes of the meeting; terms of reference; action items"
