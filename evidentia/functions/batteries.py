"""Claims with the verdicts that are expected of them, for a look at a checker as a whole."""

# Well-known claims (claim, expected verdict, note).
CORE = (
    ("The RMS Titanic sank on April 15, 1912, after hitting an iceberg.", "SUPPORTS", "Core historical fact"),
    ("The Titanic was built and launched in Southampton, England.", "REFUTES", "Built in Belfast (Harland & Wolff)"),
    ("Over 1,500 people died in the Titanic disaster.", "SUPPORTS", "Well-documented death toll"),
    ("The Titanic had enough lifeboats for all passengers and crew on board.", "REFUTES", "Famous for having far too few lifeboats"),
    ("Albert Einstein failed mathematics in school as a child.", "REFUTES", "Common myth — he actually excelled"),
    ("Vaccines cause autism.", "REFUTES", "Debunked by extensive scientific research"),
    ("The Great Wall of China is visible from space with the naked eye.", "REFUTES", "NASA confirmed it is NOT visible"),
)

# Posts as they spread in social media (claim, expected verdict, note).
SOCIAL = (
    ("BREAKING 🚨 The government has been adding fluoride to our drinking water since the 1940s and Harvard studies PROVE it lowers children's IQ!! It's literally classified as a neurotoxin. The same people pushing fluoride are pushing vaccines and chemtrails. Wake up — they're poisoning us on purpose!! SHARE before this gets removed #fluoride #waterispoison #governmentlies", "REFUTES", "Fluoride mind-control / IQ conspiracy"),
    ("🔴 PROOF the 2020 election was STOLEN!! Dominion voting machines were secretly connected to the internet and flipped millions of votes from Trump to Biden. Sidney Powell has the server evidence and the mainstream media is suppressing it. 74 million Americans were cheated. This is treason!! REPOST before they delete it #StopTheSteal #ElectionFraud #Dominion", "REFUTES", "2020 election fraud / Dominion machines conspiracy"),
    ("Obama was NOT born in the United States — his own Kenyan grandmother said on tape she was PRESENT at his birth in Mombasa!! His birth certificate posted online is a proven digital forgery — multiple forensic experts confirmed the layers in the PDF. He was never legally eligible to be president. The entire presidency was unconstitutional!! #Birther #Obama #IllegalPresident", "REFUTES", "Obama birther conspiracy"),
    ("Y'ALL the Pentagon confirmed Taylor Swift is a psychological operation 😱 The Travis Kelce romance was STAGED to push vaccine propaganda and get young people to vote Democrat. She has government security clearances and reports directly to the DOD. This is not a theory anymore — journalists have the receipts!! #TaylorSwift #Psyop #DeepState #NFL", "REFUTES", "Taylor Swift Pentagon psyop conspiracy"),
    ("The real Paul McCartney DIED in a car crash in November 1966 and was replaced by a lookalike named William Campbell 😢 The Beatles hid clues everywhere — he's barefoot on the Abbey Road cover, John whispers 'I buried Paul' on Strawberry Fields, and the license plate reads 28 IF (as in 28 IF Paul had lived). Listen again and you'll hear it. #PaulIsDead #Beatles #HiddenTruth", "REFUTES", "Paul McCartney death hoax conspiracy"),
    ("Beyoncé NEVER carried Blue Ivy herself — her baby bump literally FOLDED on live TV because it was a PROSTHETIC 😂😂 She hired a surrogate and faked the whole pregnancy for publicity. They couldn't even get the prop right on camera. Hollywood elites do this all the time and the media covers for them!! #Beyonce #FakePregnancy #SurrogateGate #CelebrityLies", "REFUTES", "Beyoncé fake pregnancy conspiracy"),
    ("On this day in history 🕊️ Nelson Mandela walked free from Victor Verster Prison on February 11, 1990, after 27 years of imprisonment for his anti-apartheid activism. His release was broadcast live around the world and marked a turning point for South Africa. One of the most powerful moments of the 20th century. #Mandela #SouthAfrica #Freedom", "SUPPORTS", "TRUE — Mandela release date and imprisonment length"),
    ("November 9, 1989 — the Berlin Wall fell 🧱✊ After 28 years of dividing East and West Germany, thousands of citizens began tearing it down with their own hands after the East German government announced open borders. It marked the beginning of the end of the Cold War. An extraordinary night that changed history forever. #BerlinWall #ColdWar #History", "SUPPORTS", "TRUE — Berlin Wall fall date and context"),
    ("A reminder for everyone 🚀 The Apollo 11 mission successfully landed astronauts on the Moon on July 20, 1969. Neil Armstrong was the first human to set foot on the lunar surface, followed by Buzz Aldrin. Michael Collins orbited above in the command module. NASA has preserved all original mission data and footage. #Apollo11 #MoonLanding #NASA", "SUPPORTS", "TRUE — Apollo 11 moon landing date and crew"),
    ("The US Congress certified the 2020 presidential election results on January 7, 2021, confirming Joe Biden as the winner with 306 electoral votes. All 50 states had certified their results. More than 60 lawsuits challenging the election were dismissed by courts, including judges appointed by both parties. #Election2020 #ElectoralCollege", "SUPPORTS", "TRUE — 2020 election certification facts"),
    ("Just a reminder that Elvis Presley passed away on August 16, 1977, at his Graceland estate in Memphis, Tennessee. The official cause of death was cardiac arrhythmia. He was 42 years old. Rest in peace, the King of Rock and Roll 🎸👑", "SUPPORTS", "TRUE — Elvis death date and cause"),
    ("Sending so much love to Celine Dion 💙 She confirmed she has been diagnosed with Stiff Person Syndrome, an extremely rare neurological disorder that affects roughly 1 in a million people and causes severe muscle stiffness and spasms. This is why she had to cancel her world tour. Wishing her strength and recovery 🙏 #CelineDion #StiffPersonSyndrome", "SUPPORTS", "TRUE — Celine Dion Stiff Person Syndrome diagnosis"),
    ("Robin Williams passed away on August 11, 2014 at his home in Paradise Cay, California 💙 His death was ruled a suicide. His wife later revealed he had been suffering from Lewy Body Dementia — a devastating disease that had gone undiagnosed. His family shared his story publicly to raise awareness. Truly one of the greatest 🌟 #RobinWilliams #LewyBodyDementia", "SUPPORTS", "TRUE — Robin Williams death and Lewy Body Dementia"),
)

# Posts in English and Arabic (claim, expected verdict, note).
NEWS = (
    ("On this day 🚀 NASA's Perseverance rover touched down on Mars on February 18, 2021 after a 7-month journey! The 'seven minutes of terror' landing went flawlessly and it's still exploring Jezero Crater today. Humanity on another planet 🔴🛰️ #Mars #Perseverance #NASA", "SUPPORTS", "EN TRUE — Perseverance Mars landing date"),
    ("ذكرى لا تُنسى ⚽🏆 استضافت قطر بطولة كأس العالم لكرة القدم 2022، وكانت أول دولة عربية تنظّم الحدث على الإطلاق! حفل الافتتاح كان مبهراً وتوّجت الأرجنتين باللقب. فخر لكل العرب 🇶🇦 #كأس_العالم#قطر2022", "SUPPORTS", "AR TRUE — 2022 FIFA World Cup held in Qatar"),
)

BATTERIES = {"core": CORE, "social": SOCIAL, "news": NEWS}
