"""A family register made of the customers, and the people operators over it, with SQL oracles.

Customer k is a person; couple j is customer 2j and a sister of a neighbouring couple; customers 6j to 6j + 5 are its
children, up to thirteen founders have no parents. Some records are made faulty by their number, so that every
rule has something to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import alignment, kinship, matcher, privacy, search, validation
from kinweave.operators import people as people_rows
from kinweave.operators.people import People
from kinweave.session import materialize, table

MALE = ("Janez", "Franc", "Anton", "Jozef", "Martin", "Gregor", "Luka", "Matija", "Peter", "Simon", "Urban", "Valentin")
FEMALE = ("Marija", "Ana", "Neza", "Marjeta", "Katarina", "Helena", "Uršula", "Jera", "Magdalena", "Barbara", "Lucija", "Eva")
SURNAMES = ("Novak", "Kovač", "Zupan", "Rajgelj", "Fajfar", "Božič", "Weiss", "Jereb", "Oblak", "Hribar", "Kos", "Mlakar")
PLACES = ("Kranj", "Bled", "Ljubljana", "Radovljica", "Celje", "Škofja Loka", "Kamnik")


def _pick(words: tuple[str, ...], at):
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))


def persons(spark, d):
    """(k, sex, given, surname, born, died) of every customer, before faults."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    chain = F.expr("aggregate(sequence(1, 40), named_struct('x', k, 'y', 0L), (s, i) -> if(s.x < 14, s, named_struct('x', 2L * (s.x div 6), 'y', s.y + 22 + (s.x * 7) % 17)))")
    c = c.withColumn("s", chain).withColumn("born", (F.lit(1650) + 7 * F.col("s.x") + F.col("s.y")).cast("int"))
    k = F.col("k")
    c = c.withColumn("died", F.when(k % 4 != 1, F.when(k % 101 == 0, F.col("born") - 3).otherwise(F.col("born") + 30 + (k * 13) % 75)).cast("int"))
    sex = F.when(k % 89 == 3, "U").when((k % 2 == 0) != (k % 151 == 7), "M").otherwise("F")
    given = F.when(k % 2 == 0, _pick(MALE, k * 31 + F.floor(k / 12))).otherwise(_pick(FEMALE, k * 31 + F.floor(k / 12)))
    surname = F.concat(_pick(SURNAMES, F.col("s.x") * 5), F.when(k % 17 == 0, "c").otherwise(""))
    return c.select("k", sex.alias("sex"), given.alias("given"), surname.alias("surname"), "born", "died")


def _pid(k):
    return F.concat(F.lit("P"), k.cast("string"))


def _couples(spark, d):
    """(j, h, w): numbers of husband and wife, of which some are not in the register."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    j = c.filter("k % 2 = 0").select(F.floor(F.col("k") / 2).cast("long").alias("j"))
    # 4 more or less: the other bit, in plain arithmetic
    other = F.when(F.floor(F.col("j") / 4) % 2 == 0, F.col("j") + 4).otherwise(F.col("j") - 4)
    wife = c.filter("k % 2 = 1").select(F.col("k").alias("w"))
    two = j.withColumn("w0", 2 * other + 1).join(wife, F.col("w0") == F.col("w"), "left")
    return two.select("j", F.when(F.col("j") % 41 != 0, 2 * F.col("j")).alias("h"), "w")


def register(spark, d) -> tuple[People, object]:
    """The people of the register and their FAMC and FAMS links."""
    p, c = persons(spark, d), _couples(spark, d)
    k, j = F.col("k"), F.col("j")
    name = F.when(k % 103 != 0, F.concat_ws(" ", "given", "surname"))
    ind = p.select(_pid(k).alias("id"), k.alias("ord"), name.alias("name"), F.when(k % 103 != 0, F.col("given")).alias("given"), F.when(k % 103 != 0, F.col("surname")).alias("surname"), "sex")
    fid = F.concat(F.lit("F"), j.cast("string"))
    kids = p.filter("k >= 14 and k % 61 != 0").select(k, F.floor(k / 6).cast("long").alias("j"))
    child = kids.join(c.select("j"), "j", "left_semi")
    edges = c.filter("h is not null").select(fid.alias("fam_id"), _pid(F.col("h")).alias("person_id"), F.lit("husband").alias("role"), F.lit(1).alias("ord"))
    for rows in (
        c.filter("w is not null").select(fid, _pid(F.col("w")), F.lit("wife"), F.lit(2)),
        child.select(fid, _pid(k), F.lit("child"), (3 + k % 6).cast("int")),
        child.filter("k % 109 = 0").select(fid, _pid(k), F.lit("child"), F.lit(20)),
        c.filter("j % 97 = 0").select(fid, _pid(j + 90_000_000), F.lit("child"), F.lit(21)),
        c.filter("j % 131 = 0 and h is not null").select(fid, _pid(2 * j + 20), F.lit("husband"), F.lit(0)),
        p.filter("k % 113 = 0").select(F.concat(F.lit("G"), k.cast("string")), _pid(k), F.lit("child"), F.lit(1)),
    ):
        edges = edges.union(rows)
    links = child.select(_pid(k).alias("person_id"), fid.alias("fam_id"), F.lit("FAMC").alias("tag"), F.lit(1).alias("ord"), F.when(k % 29 == 0, "adopted").alias("pedi"))
    none = F.lit(None).cast("string")
    for rows in (
        p.filter("k % 113 = 0").select(_pid(k), F.concat(F.lit("G"), k.cast("string")), F.lit("FAMC"), F.lit(2), none),
        p.filter("k % 139 = 0").select(_pid(k), F.concat(F.lit("X"), k.cast("string")), F.lit("FAMC"), F.lit(3), none),
        child.filter("k % 149 = 0").select(_pid(k), fid, F.lit("FAMC"), F.lit(4), none),
        c.filter("h is not null").select(_pid(F.col("h")), fid, F.lit("FAMS"), F.lit(5), none),
        c.filter("w is not null").select(_pid(F.col("w")), fid, F.lit("FAMS"), F.lit(5), none),
        c.filter("j % 127 = 0 and h is not null").select(_pid(F.col("h") + 2), fid, F.lit("FAMS"), F.lit(6), none),
    ):
        links = links.union(rows)
    links = links.join(ind.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    families = c.select(fid.alias("fam_id")).union(p.filter("k % 113 = 0").select(F.concat(F.lit("G"), k.cast("string")))).union(p.filter("k % 173 = 0").select(F.concat(F.lit("E"), k.cast("string"))))
    month = F.element_at(F.array(*map(F.lit, ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"))), (k % 12 + 1).cast("int"))
    born = F.when(k % 5 == 0, F.col("born").cast("string")).when(k % 5 == 1, F.concat(F.lit("ABT "), F.col("born").cast("string"))).otherwise(F.concat_ws(" ", (k % 28 + 1).cast("string"), month, F.col("born").cast("string")))
    place, nowhere = _pick(PLACES, F.floor(k / 6)), F.lit(None).cast("string")
    events = p.filter("k % 37 != 5").select(_pid(k).alias("owner"), F.lit("BIRT").alias("tag"), F.lit(1).alias("ord"), born.alias("date"), F.when(k % 3 != 0, place).alias("place"), nowhere.alias("address"))
    wed = p.select((k / 2).cast("long").alias("j"), F.col("born").alias("hb"), k.alias("hk")).filter("hk % 2 = 0")
    for rows in (
        p.filter("died is not null").select(_pid(k), F.lit("DEAT"), F.lit(5), F.col("died").cast("string"), F.when(k % 2 == 0, place), nowhere),
        p.filter("died is not null and k % 11 = 0").select(_pid(k), F.lit("PROB"), F.lit(6), (F.col("died") + 1).cast("string"), nowhere, nowhere),
        p.filter("died is not null and k % 67 = 0").select(_pid(k), F.lit("OCCU"), F.lit(4), (F.col("died") + 2).cast("string"), nowhere, nowhere),
        p.filter("k % 71 = 0").select(_pid(k), F.lit("RESI"), F.lit(3), (F.col("born") - 1).cast("string"), place, nowhere),
        p.filter("k % 211 = 0").select(_pid(k), F.lit("OCCU"), F.lit(2), F.lit("FROM 1900 TO 2999"), nowhere, nowhere),
        c.filter("j % 3 != 0 and h is not null").join(wed.select("j", "hb"), "j").select(fid, F.lit("MARR"), F.lit(1), (F.col("hb") + (j * 3) % 95).cast("string"), _pick(PLACES, j), nowhere),
    ):
        events = events.union(rows)
    return People(materialize(ind), materialize(edges.toDF("fam_id", "person_id", "role", "ord")), materialize(events), families=families), materialize(links)


#: The same register in DuckDB: persons with years as numbers, edges, links, events.
REGISTER = """recursive up as (select c_custkey as k, c_custkey as x, 0 as y from customer union all select k, 2 * (x // 6), y + 22 + (x * 7) % 17 from up where x >= 14),
p0 as (select k, x, 1650 + 7 * x + y as born from up where x < 14),
p as (select k, 'P' || k as id, x, born, case when k % 4 <> 1 then case when k % 101 = 0 then born - 3 else born + 30 + (k * 13) % 75 end end as died,
      case when k % 89 = 3 then 'U' when (k % 2 = 0) <> (k % 151 = 7) then 'M' else 'F' end as sex, case when k % 37 <> 5 then born end as by_ from p0),
cp as (select k // 2 as j, case when (k // 2) % 41 <> 0 then k end as h, case when (k // 2) // 4 % 2 = 0 then k // 2 + 4 else k // 2 - 4 end * 2 + 1 as w0 from p where k % 2 = 0),
c as (select j, 'F' || j as fam, h, case when w0 in (select k from p) then w0 end as w from cp),
ch as (select p.k, p.id, c.j, c.fam from p join c on c.j = p.k // 6 where p.k >= 14 and p.k % 61 <> 0),
edges as (select fam, 'P' || h as id, 'husband' as role, 1 as o from c where h is not null union all select fam, 'P' || w, 'wife', 2 from c where w is not null
  union all select fam, id, 'child', 3 from ch union all select fam, id, 'child', 20 from ch where k % 109 = 0 union all select fam, 'P' || (j + 90000000), 'child', 21 from c where j % 97 = 0
  union all select fam, 'P' || (2 * j + 20), 'husband', 0 from c where j % 131 = 0 and h is not null union all select 'G' || k, id, 'child', 1 from p where k % 113 = 0),
links0 as (select id, fam, 'FAMC' as tag, case when k % 29 = 0 then 'adopted' end as pedi from ch union all select id, 'G' || k, 'FAMC', null from p where k % 113 = 0
  union all select id, 'X' || k, 'FAMC', null from p where k % 139 = 0 union all select id, fam, 'FAMC', null from ch where k % 149 = 0
  union all select 'P' || h, fam, 'FAMS', null from c where h is not null union all select 'P' || w, fam, 'FAMS', null from c where w is not null
  union all select 'P' || (h + 2), fam, 'FAMS', null from c where j % 127 = 0 and h is not null),
links as (select * from links0 where id in (select id from p)),
fams as (select fam from c union all select 'G' || k from p where k % 113 = 0 union all select 'E' || k from p where k % 173 = 0),
wed as (select c.fam, q.born + (c.j * 3) % 95 as y from c join p q on q.k = 2 * c.j where c.j % 3 <> 0 and c.h is not null),
ev as (select id, k, 'BIRT' as tag, born as y, null::bigint as y2 from p where k % 37 <> 5 union all select id, k, 'DEAT', died, null::bigint from p where died is not null
  union all select id, k, 'PROB', died + 1, null::bigint from p where died is not null and k % 11 = 0 union all select id, k, 'OCCU', died + 2, null::bigint from p where died is not null and k % 67 = 0
  union all select id, k, 'RESI', born - 1, null::bigint from p where k % 71 = 0 union all select id, k, 'OCCU', 1900, 2999 from p where k % 211 = 0),
pr as (select f.fam, c.h, c.w, h.id as hid, w.id as wid, h.sex as hs, w.sex as ws, h.by_ as hb, w.by_ as wb, h.died as hd, w.died as wd from fams f left join c on c.fam = f.fam
  left join p h on h.k = c.h left join p w on w.k = c.w)"""


VALIDATE_PEOPLE = f"""with {REGISTER},
kid as (select e.fam, q.id, q.k, q.by_, pr.* exclude (fam) from edges e join p q on q.id = e.id join pr on pr.fam = e.fam where e.role = 'child' and q.by_ is not null),
bred as (select * from kid where id || fam not in (select id || fam from links where tag = 'FAMC' and pedi = 'adopted')),
bm as (select fam, wid, hid, by_ * 12 + case when k % 5 in (0, 1) then 6 else k % 12 + 1 end - 1 as m from bred where hid is not null and wid is not null),
run as (select fam, wid, hid, min(m) as lo, max(m) as hi from bm group by all),
hit as (select a.wid, a.fam as fa, b.fam as fb, a.hid as pa, b.hid as pb from run a join bm b on a.wid = b.wid and a.fam <> b.fam and a.hid <> b.hid where a.hi - a.lo >= 18 and b.m between a.lo + 9 and a.hi - 9),
par as (select wid, pa, pb from hit qualify row_number() over (partition by wid, least(fa, fb), greatest(fa, fb) order by (fa <> least(fa, fb))::int, pa, pb) = 1),
mf as (select id from links where tag = 'FAMC' group by id having count(*) > 1),
t as (
  select 'individual' as scope, id, 'missingName' as category, '' as detail from p where k % 103 = 0
  union all select 'individual', id, 'missingSex', '' from p where sex = 'U'
  union all select 'individual', id, 'missingVitals', '' from p where by_ is null and died is null
  union all select 'individual', id, 'deathBeforeBirth', died::varchar from p where died < by_
  union all select 'individual', id, 'ageAtDeath', (died - by_)::varchar from p where died - by_ > 99
  union all select 'individual', id, 'livingTooOld', (2024 - by_)::varchar from p where died is null and 2024 - by_ > 99
  union all select 'individual', ev.id, 'eventOrder', tag || ' before birth' from ev join p using (id) where y < by_ and not (tag = 'DEAT' and y = died)
  union all select 'individual', ev.id, 'eventOrder', tag || ' after death' from ev join p using (id) where y > died and tag not in ('DEAT', 'PROB') and not coalesce(y < by_, false)
  union all select 'individual', l.id, 'eventOrder', 'MARR after death' from (select distinct id, fam from links where tag = 'FAMS') l join wed using (fam) join p on p.id = l.id where wed.y > died
  union all select 'individual', id, 'futureDate', max(greatest(y, coalesce(y2, y)))::varchar from ev group by id having max(greatest(y, coalesce(y2, y))) > 2024
  union all select 'individual', id, 'orphan', '' from p where id not in (select id from links)
  union all select 'individual', id, 'brokenLink', tag || ' missing ' || fam from links where fam not in (select fam from fams)
  union all select 'individual', id, 'brokenLink', tag || ' one way ' || fam from links l where fam in (select fam from fams) and not exists (select 1 from edges e where e.fam = l.fam and e.id = l.id and (e.role = 'child') = (l.tag = 'FAMC') and e.o <> 0)
  union all select * from (select 'individual', id, 'duplicatePointer', tag || ' ' || fam from links group by id, tag, fam having count(*) > 1) as q
  union all select * from (select 'individual', id, 'multipleParents', count(distinct fam)::varchar from links where tag = 'FAMC' and pedi is null and id in (select id from mf) and fam in (select fam from fams) group by id having count(distinct fam) > 1) as q
  union all select 'individual', l.id, 'parentlessFamily', l.fam from links l join pr on pr.fam = l.fam where tag = 'FAMC' and l.id in (select id from mf) and pr.h is null and pr.w is null
  union all select 'family', fam, 'parentlessFamily', 'no members' from fams where fam not in (select fam from edges)
  union all select 'individual', hid, 'roleSexConflict', 'husband' from pr where hs = 'F' and coalesce(ws, '') <> 'F'
  union all select 'individual', wid, 'roleSexConflict', 'wife' from pr where ws = 'M' and coalesce(hs, '') <> 'M'
  union all select 'individual', hid, 'ageAtMarriage', (y - hb)::varchar from pr join wed using (fam) where y - hb not between 12 and 90
  union all select 'individual', wid, 'ageAtMarriage', (y - wb)::varchar from pr join wed using (fam) where y - wb not between 12 and 90
  union all select 'individual', case when hb <= wb then hid else wid end, 'spouseAgeGap', abs(hb - wb)::varchar from pr where abs(hb - wb) > 32
  union all select 'individual', id, 'parentAge', 'father ' || (by_ - hb) from kid where by_ - hb not between 14 and 80
  union all select 'individual', id, 'parentAge', 'mother ' || (by_ - wb) from kid where by_ - wb not between 14 and 50
  union all select 'individual', id, 'bornAfterParentDeath', 'father' from bred where by_ > hd + 1
  union all select 'individual', id, 'bornAfterParentDeath', 'mother' from bred where by_ > wd
  union all select 'individual', wid, 'parallelFamilies', pa || ' ' || pb from par
  union all select 'family', fam, 'multiSpouseSlot', role from edges where role <> 'child' group by fam, role having count(distinct id) > 1
  union all select 'family', fam, 'brokenLink', 'child missing ' || id from edges where role = 'child' and id not in (select id from p)
  union all select * from (select 'family', fam, 'duplicatePointer', 'CHIL ' || id from edges where role = 'child' group by fam, id having count(*) > 1) as q)
select scope, id, category, case when category in ('brokenLink', 'pedigreeLoop', 'roleSexConflict', 'deathBeforeBirth', 'futureDate') then 'error' else 'warning' end as severity, detail, count(*) as n from t group by all"""


def validate_people(spark, d):
    """All rules but loops and islands, which SQL cannot follow at any size; they have queries of their own."""
    people, links = register(spark, d)
    return validation.validate(people, links).filter("category not in ('pedigreeLoop', 'island')")


def _other_file(people: People) -> People:
    """The register as another hand wrote it: two thirds of the people, other spellings, years off by one, no addresses."""
    n = F.regexp_extract("id", r"\d+", 0).cast("long")
    kept = n % 3 != 0
    forms = {"Janez": "Johannes", "Franc": "Franciscus", "Anton": "Antonius", "Jozef": "Josephus", "Neza": "Agnes", "Jera": "Gertrudis", "Marija": "Maria"}
    latin = F.col("given")
    for a, b in forms.items():
        latin = F.when(F.col("given") == a, b).otherwise(latin)

    def other(c: str):
        # families keep their letter behind another one, so that no family has a person's id
        return F.when(F.col(c).startswith("P"), F.concat(F.lit("Q"), F.substring(c, 2, 20))).otherwise(F.concat(F.lit("Y"), F.col(c)))

    ind = people.individuals.filter(kept).withColumn("given", F.when(n % 5 == 0, latin).otherwise(F.col("given"))).withColumn("surname", F.when(n % 7 == 0, F.concat("surname", F.lit("c"))).otherwise(F.col("surname")))
    ind = ind.withColumn("name", F.concat_ws(" ", "given", "surname")).withColumn("id", other("id"))
    person = F.regexp_extract("person_id", r"\d+", 0).cast("long")
    edges = people.edges.filter(person % 3 != 0).withColumns({"person_id": other("person_id"), "fam_id": other("fam_id")})
    owner = F.regexp_extract("owner", r"\d+", 0).cast("long")
    year = F.regexp_extract("date", r"(\d{4})$", 1).cast("int")
    date = F.when((owner % 19 == 0) & F.col("date").startswith("ABT"), F.concat(F.lit("ABT "), (year + 1).cast("string"))).when(owner % 23 == 0, F.concat(F.lit("BEF "), (year + 2).cast("string"))).otherwise(F.col("date"))
    events = people.events.withColumns({"date": date, "owner": other("owner")})
    return People(ind, edges, events)


def two_files(spark, d) -> tuple[People, People]:
    main, _ = register(spark, d)
    n = F.regexp_extract("id", r"\d+", 0).cast("long")
    main = People(main.individuals.withColumn("uids", F.when(n % 10 == 4, F.array(F.concat(F.lit("{0000-0000-"), n.cast("string"), F.lit("-AB}")))).otherwise(F.array().cast("array<string>"))), main.edges, main.events)
    return main, _other_file(main)


def match_datasets(spark, d):
    return matcher.match_datasets(*two_files(spark, d))[0]


def incoming_duplicates(spark, d):
    """The other file holds some of its people twice, which the match finds through the main person."""
    main, other = two_files(spark, d)
    twice = other.individuals.filter("ord % 13 = 1").withColumns({"id": F.concat(F.lit("R"), F.substring("id", 2, 20)), "uids": F.array().cast("array<string>")})
    births = other.events.join(twice.select(F.concat(F.lit("Q"), F.substring("id", 2, 20)).alias("owner")), "owner", "left_semi").filter("tag = 'BIRT'").withColumn("owner", F.concat(F.lit("R"), F.substring("owner", 2, 20)))
    return matcher.match_datasets(main, People(other.individuals.unionByName(twice), other.edges, other.events.unionByName(births)))[1]


def score_people(spark, d):
    """Every component of the pairs that block keys and gates leave."""
    main, other = two_files(spark, d)
    mp, cp = materialize(people_rows.profiles(main)), materialize(people_rows.profiles(other))
    return matcher.scored_candidates(mp, cp).select("main_id", "compare_id", "score", "category", "components")


def identity_match(spark, d):
    main, other = two_files(spark, d)
    return matcher.identity_matches(main.individuals, other.individuals)


def duplicate_people(spark, d):
    """The register with a tenth of its people entered again."""
    main, _ = register(spark, d)
    again = main.individuals.filter("ord % 10 = 6").withColumn("id", F.concat(F.lit("D"), F.substring("id", 2, 20)))
    edges = main.edges.filter("role = 'child'").join(again.select(F.concat(F.lit("P"), F.substring("id", 2, 20)).alias("person_id")), "person_id", "left_semi")
    events = main.events.join(again.select(F.concat(F.lit("P"), F.substring("id", 2, 20)).alias("owner")), "owner", "left_semi")
    copy = lambda c: F.concat(F.lit("D"), F.substring(c, 2, 20))
    both = People(main.individuals.unionByName(again), main.edges.unionByName(edges.withColumn("person_id", copy("person_id"))), main.events.unionByName(events.withColumn("owner", copy("owner"))))
    return matcher.find_duplicates(both)


def birth_estimates(spark, d):
    people, _ = register(spark, d)
    years = people_rows.vitals(people.individuals, people_rows.dated(people.events))
    return people_rows.birth_estimates(people.individuals, people.edges, years)


BIRTH_ESTIMATES = f"""with {REGISTER},
par as (select distinct e.id as kid, s.id as parent, e.fam from edges e join (select fam, max_by(id, o) filter (role = 'husband') as h, max_by(id, o) filter (role = 'wife') as w from edges group by fam) q using (fam), lateral (select unnest([h, w]) as id) s where e.role = 'child' and s.id is not null),
sp as (select h as a, w as b, fam from (select fam, max_by(id, o) filter (role = 'husband') as h, max_by(id, o) filter (role = 'wife') as w from edges group by fam) q where h is not null and w is not null and h <> w),
ca as (select p.id, r.by_ as v from p join (select a as x, b as y from sp union all select b, a from sp) s on s.x = p.id join p r on r.id = s.y where r.by_ is not null
  union all select p.id, r.by_ + 29 from p join (select e.id as kid, s.id as parent from edges e join (select fam, max_by(id, o) filter (role = 'husband') as h, max_by(id, o) filter (role = 'wife') as w from edges group by fam) q using (fam), lateral (select unnest([h, w]) as id) s where e.role = 'child' and s.id is not null) u on u.kid = p.id join p r on r.id = u.parent where r.by_ is not null
  union all select p.id, min(r.by_) - case p.sex when 'F' then 27 when 'M' then 38 else 32 end from p join par on par.parent = p.id join p r on r.id = par.kid where r.by_ is not null group by p.id, p.sex)
select id, cast(list_sort(list(v))[(count(*) // 2 + 1)::int] as int) as estimate from ca group by id"""
IDENTITY = """select 'P' || c_custkey as main_id, 'Q' || c_custkey as compare_id from customer where c_custkey % 10 = 4 and c_custkey % 3 <> 0 and length('00000000' || c_custkey || 'AB') >= 12"""


def _rows(spark, d):
    people, _ = register(spark, d)
    facts = people.individuals.select("id", F.concat(F.lit("Zapis "), (F.col("ord") % 7).cast("string")).alias("notes"), (F.col("ord") % 5 == 0).alias("private"), F.array(F.concat(F.lit("M"), F.col("ord") % 3)).alias("media_xrefs"), (F.col("ord") % 4 == 0).alias("sources"))
    return search.person_rows(people, facts.filter("id not like '%7'"))


def person_rows(spark, d):
    return _rows(spark, d).select("id", "sex", "span", "birth_year", "death_year", "deceased", "age", "has_spouse", "has_child", "has_parent", F.array_join(F.array_sort("event_tags"), " ").alias("event_tags"), F.array_join("family_tags", " ").alias("family_tags"), "search_text", "note_text")


SPOUSES = "sl as (select fam, max_by(id, o) filter (role = 'husband') as h, max_by(id, o) filter (role = 'wife') as w from edges group by fam)"
PERSON_ROWS = f"""with {REGISTER}, {SPOUSES},
r as (select p.*, died is not null as dead, case when k % 2 = 0 then list_extract(['janez', 'franc', 'anton', 'jozef', 'martin', 'gregor', 'luka', 'matija', 'peter', 'simon', 'urban', 'valentin'], ((k * 31 + k // 12) % 12 + 1)::int)
   else list_extract(['marija', 'ana', 'neza', 'marjeta', 'katarina', 'helena', 'ursula', 'jera', 'magdalena', 'barbara', 'lucija', 'eva'], ((k * 31 + k // 12) % 12 + 1)::int) end as g,
   list_extract(['novak', 'kovac', 'zupan', 'rajgelj', 'fajfar', 'bozic', 'weiss', 'jereb', 'oblak', 'hribar', 'kos', 'mlakar'], ((x * 5) % 12 + 1)::int) || case when k % 17 = 0 then 'c' else '' end as s from p),
q as (select *, case when by_ is not null and died is not null then by_ || '–' || died when by_ is not null then by_::varchar when died is not null then '–' || died else '' end as span from r),
et as (select id, string_agg(distinct tag, ' ' order by tag) as t from ev group by id),
ft as (select e.id, 'MARR' as t from edges e join wed using (fam) where e.role <> 'child' group by e.id),
rs as (select h as id from sl where w is not null and h <> w union select w from sl where h is not null and h <> w),
rc as (select s.id from edges e join sl using (fam), lateral (select unnest([h, w]) as id) s where e.role = 'child' and s.id is not null group by 1),
rp as (select e.id from edges e join sl using (fam) where e.role = 'child' and (h is not null or w is not null) group by 1)
select id, sex, span, by_ as birth_year, died as death_year, dead as deceased, cast(case when by_ is null then null when dead then greatest(0, died - by_) else greatest(0, 2024 - by_ - case when k % 5 in (0, 1) then 0 when k % 12 + 1 > 1 then 1 when k % 28 + 1 > 1 then 1 else 0 end) end as int) as age,
  id in (select id from rs) as has_spouse, id in (select id from rc) as has_child, id in (select id from rp) as has_parent, coalesce(et.t, '') as event_tags, coalesce(ft.t, '') as family_tags,
  trim(case when k % 103 <> 0 then g || ' ' || s else '' end || ' ' || span) as search_text, case when id like '%7' then '' else 'zapis ' || k % 7 end as note_text
from q left join et using (id) left join ft using (id)"""


CRITERIA = [
    {"kind": "sex", "value": "F"}, {"kind": "birthYear", "start": 1700, "end": 1900}, {"kind": "relation", "rel": "children", "mode": "has"}, {"kind": "event", "tag": "PROB", "mode": "lacks"},
    {"kind": "private", "value": False}, {"kind": "media", "mode": "has", "xref": "M1"}, {"kind": "name", "text": "a", "part": "given"}, {"kind": "age", "op": "gte", "years": 30}, {"kind": "living", "value": False},
]


def batch_people(spark, d):
    return search.batch_filter(_rows(spark, d), CRITERIA).select("id", "age")


BATCH_PEOPLE = PERSON_ROWS.replace("select id, sex, span, by_", "select k, id, sex, g, span, by_", 1)
BATCH_PEOPLE = f"""with b as ({BATCH_PEOPLE}) select id, age from b where sex = 'F' and birth_year between 1700 and 1900 and has_child and not contains(' ' || event_tags || ' ', ' PROB ')
  and (id like '%7' or (k % 5 <> 0)) and id not like '%7' and k % 3 = 1 and k % 103 <> 0 and contains(g, 'a') and age >= 30 and deceased"""


def search_register(spark, d):
    return search.search_people(_rows(spark, d), "a novak", sex="M", born_from=1700, notes=True).select("id", "search_text")


SEARCH_REGISTER = PERSON_ROWS.replace("select id, sex, span, by_", "select k, id, sex, g, s, span, by_", 1)
SEARCH_REGISTER = f"""with b as ({SEARCH_REGISTER}) select id, search_text from b where contains(search_text, 'a') and contains(search_text, 'novak') and sex = 'M' and birth_year >= 1700 and id not like '%7'
  order by g || ' ' || s, birth_year * 10000 + case when k % 5 in (0, 1) then 0 else (k % 12 + 1) * 100 + k % 28 + 1 end, coalesce(death_year, 999999), id limit 50"""


def kinship_people(spark, d):
    people, _ = register(spark, d)
    return search.kinship_sets(people, "P101").filter("ancestor or descendant or blood")


KINSHIP_PEOPLE = f"""with {REGISTER}, {SPOUSES}, pa as (select distinct e.id as kid, s.id as par from edges e join sl using (fam), lateral (select unnest([h, w]) as id) s where e.role = 'child' and s.id is not null),
a as (select par as id from pa where kid = 'P101' union select pa.par from a join pa on pa.kid = a.id), ds as (select kid as id from pa where par = 'P101' union select pa.kid from ds join pa on pa.par = ds.id),
bl as (select id from a union select 'P101' union select pa.kid from bl join pa on pa.par = bl.id)
select p.id, p.id in (select id from a) as ancestor, p.id in (select id from ds) as descendant, p.id in (select id from bl) as blood from p where p.id in (select id from a) or p.id in (select id from ds) or p.id in (select id from bl)"""


def kinship_labels(spark, d):
    return kinship.kinship_labels(register(spark, d)[0], "P101")


def line_sides(spark, d):
    return search.line_sides(register(spark, d)[0], "P101")


def presumed_living(spark, d):
    people, _ = register(spark, d)
    return kinship.presumed_living(people, people_rows.vitals(people.individuals, people_rows.dated(people.events)))


def register_numbers(spark, d):
    people, _ = register(spark, d)
    vital = people_rows.vitals(people.individuals, people_rows.dated(people.events))
    return kinship.descendant_register(people, "P14", vital.select("id", "birth_key"))


def unions_by_marriage(spark, d):
    people, _ = register(spark, d)
    weddings = people_rows.dated(people.events.filter("tag = 'MARR'")).select(F.col("owner").alias("fam_id"), F.col("d.year").alias("key"))
    return kinship.unions_by_marriage(people, weddings)


UNIONS = f"""with {REGISTER}, {SPOUSES}, u as (select fam, unnest([h, w]) as id from sl) select u.id, u.fam as fam_id, cast(row_number() over (partition by u.id order by wed.y nulls last, u.fam) as int) as place from u left join wed using (fam) where u.id is not null"""


def align_events(spark, d):
    """Events of every person and the same person in the other file."""
    main, other = two_files(spark, d)
    pairs = main.individuals.select(F.col("id").alias("main_id"), F.concat(F.lit("Q"), F.substring("id", 2, 20)).alias("compare_id")).join(other.individuals.select(F.col("id").alias("compare_id")), "compare_id", "left_semi")
    ready = [people_rows.dated(x.events.withColumn("value", F.lit(None).cast("string"))) for x in (main, other)]
    return alignment.align_events(pairs, *ready)


def living_people(spark, d):
    people, _ = register(spark, d)
    vital = people_rows.vitals(people.individuals, people_rows.dated(people.events))
    private = people.individuals.filter("ord % 31 = 0").select("id")
    return privacy.living_reasons(people, vital, private, recently=5, unknown_living=True)


LIVING_PEOPLE = f"""with {REGISTER}, {SPOUSES},
rel as (select e.id, s.id as r, 28 as d from edges e join sl using (fam), lateral (select unnest([h, w]) as id) s where e.role = 'child' and s.id is not null
  union all select s.id, e.id, -28 from edges e join sl using (fam), lateral (select unnest([h, w]) as id) s where e.role = 'child' and s.id is not null
  union all select h, w, 0 from sl where h is not null and w is not null and h <> w union all select w, h, 0 from sl where h is not null and w is not null and h <> w),
est as (select rel.id, max(p.by_ + d) as y from rel join p on p.id = rel.r where p.by_ is not null group by rel.id),
x as (select p.id, case when k % 31 = 0 then 'declared' when died is not null then case when 2024 - died <= 5 then 'recentDeath' end when by_ is not null then case when 2024 - by_ < 100 then 'birth' end
  when est.y is not null then case when 2024 - est.y < 100 then 'relative' end else 'unknown' end as reason from p left join est on est.id = p.id)
select id, reason from x where reason is not null"""


def sibling_estimates(spark, d):
    people, _ = register(spark, d)
    return privacy.sibling_estimates(people, people_rows.vitals(people.individuals, people_rows.dated(people.events)), people.individuals)


def people_islands(spark, d):
    """Islands and loops of the register, the two rules SQL cannot follow."""
    people, links = register(spark, d)
    return validation.validate(people, links).filter("category in ('pedigreeLoop', 'island')")


def people_issue_counts(spark, d):
    people, links = register(spark, d)
    return validation.issue_counts(validation.validate(people, links).filter("category not in ('pedigreeLoop', 'island')")).filter("category not in ('pedigreeLoop', 'island')")


def duplicate_clusters(spark, d):
    return matcher.duplicate_clusters(materialize(duplicate_people(spark, d))).select("cluster", F.size("members").alias("members"), "pairs", "max_score", "unpaired")


QUERIES = {
    "align_events": (align_events, None),
    "living_people": (living_people, LIVING_PEOPLE),
    "sibling_estimates": (sibling_estimates, None),
    "people_islands": (people_islands, None),
    "people_issue_counts": (people_issue_counts, f"select c.category, cast(coalesce(sum(v.n), 0) as bigint) as n from (select unnest([{', '.join(repr(c) for c in validation.CATEGORIES if c not in ('pedigreeLoop', 'island'))}]) as category) c left join ({VALIDATE_PEOPLE}) v using (category) group by 1"),
    "duplicate_clusters": (duplicate_clusters, None),
    "person_rows": (person_rows, PERSON_ROWS),
    "batch_people": (batch_people, BATCH_PEOPLE),
    "search_register": (search_register, SEARCH_REGISTER),
    "kinship_people": (kinship_people, KINSHIP_PEOPLE),
    "kinship_labels": (kinship_labels, None),
    "line_sides": (line_sides, None),
    "presumed_living": (presumed_living, None),
    "register_numbers": (register_numbers, None),
    "unions_by_marriage": (unions_by_marriage, UNIONS),
    "match_datasets": (match_datasets, None),
    "incoming_duplicates": (incoming_duplicates, None),
    "score_people": (score_people, None),
    "identity_match": (identity_match, IDENTITY),
    "duplicate_people": (duplicate_people, None),
    "birth_estimates": (birth_estimates, BIRTH_ESTIMATES),
    "validate_people": (validate_people, VALIDATE_PEOPLE),
}
