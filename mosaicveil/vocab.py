"""Word lists. They are parameters: pass a Vocabulary of your own for other corpora."""

from __future__ import annotations

from dataclasses import dataclass


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


@dataclass(frozen=True)
class Vocabulary:
    given: frozenset[str] = _set(
        "aarav aditi aditya ajay akash alok amit amita amrita anand anil anita anjali ankit aparna arjun arun asha ashok bharat chitra deepa deepak "
        "abdul abhay abhishek adarsh ahmad akhil akshay alka ambika amir amol anjana ankita anuj anupam anuradha anusha arpita arvind ashwin avinash ayesha bala bhavna bhavesh bhushan bina brijesh chandan charu chetan daksha damini "
        "darshan devika dhananjay dhruv dilip dipika durga ekta fatima ganesh gauri gayatri geeta govind gulshan hardik hari harsha hemant heena himanshu hitesh indu ishaan jagdish janaki jasmine jatin jayant jitendra jyoti kailash kalpana kamal "
        "kanchan karthik kartik kashish ketan khushi komal krishna kunal lalit laxmi leela lokesh madhavi mahendra mala mallika manasi manav mansi meera megha milind mihir mira mohammed mohini monika mridula mukul murali nalini nandini narendra "
        "natasha navya neelam neeraj neeta nikita nilesh niraj niranjan nirmala nishant padma pallavi pankaj parth parvati pavan payal piyush prabha pradeep pranav prasanna pratik praveen preeti prem prerna purnima pushpa radha raghav raj raja rajan rajani rajendra "
        "rajni rama raman ramya ranjan rashmi renu ritu riya rohan roshni ruchi rupa sagar saket samir sanjana santosh sapna sarika satish shankar sharad sheetal shekhar shivani shreya shubham siddharth simran smita somnath sonal subhash sujata sukanya suman sumit sundar surabhi surendra sushma tanvi tarun tejas trupti "
        "umesh urmila vaibhav vandana varsha vasant veena venkat vidya vikas vimal vineet vipin vipul vishal vishnu yamini yogesh "
        "dinesh divya farhan gaurav gita girish gopal harish hema imran indira isha jaya karan kavita kiran kishore kushal lakshmi lata madhu mahesh "
        "manish manoj maya meena mohan mukesh naveen neha nikhil nisha nitin pooja prakash prasad priya rahul rajesh rajiv rakesh ramesh ravi rekha "
        "rohit sachin sameer sandeep sanjay sarita seema shalini shilpa shyam sneha sonia sudha sunil sunita suresh swati tara uday usha vijay vikram vinay vinod vivek yash"
    )
    surnames: frozenset[str] = _set(
        "agarwal ahmed ali arora banerjee basu bhat bose chatterjee chauhan chopra das desai deshpande dutta gandhi ghosh gupta hegde iyer jain jha joshi "
        "acharya adhikari ansari apte bajaj bakshi balakrishnan bansal barua bedi bhagat bhalla bhandari bhargava bhatia bhatt bhattacharya biswas borkar chakraborty chandra chaturvedi chaudhary chawla choudhury dalal damle dave deo deol dhar dhawan dixit doshi dubey "
        "dwivedi gaikwad garg gill goel gokhale gopalan goswami goyal gulati hussain jadhav jagtap jaiswal joglekar kadam kamat kamble kaur krishnan kaul lal lele mahajan majumdar malik mathur mehra mistry mitra modi mohanty murthy nambiar nanda narang narayan narayanan natarajan "
        "ojha padmanabhan palekar pandit pant parekh parikh pathak pawar phadke prabhu pradhan purohit raghavan raina rajput raman rana rane rastogi rathod rathore ray roy sahoo sahu salvi sanghvi sarkar sathe sawant seth sethi shaikh sheikh shekhawat sharan shroff sibal sidhu "
        "somani soni srinivasan srivastava subramanian sundaram swamy talwar tandon thakkar thapar thomas trehan upadhyay vaidya venkatesan vohra vyas wadhwa wagh walia zaveri "
        "kapoor khan khanna kulkarni kumar malhotra mehta menon mishra mukherjee nair naidu pai pandey patel patil pillai qureshi rao reddy saxena sen shah "
        "sharma shetty shinde shukla singh sinha thakur tiwari trivedi varma verma yadav"
    )
    #: Capitalised words that are no part of a person's name.
    name_stop: frozenset[str] = _set(
        "limited ltd private pvt llp company companies board issue offer equity shares section act regulations sebi indian india government registrar bank "
        "securities exchange national stock director directors promoter promoters chairman managing executive independent chief financial officer secretary "
        "compliance the our we and of for in on at to by with from red herring prospectus lead manager managers price investor risk factors page table note "
        "statements total income tax ministry reserve road street nagar plot floor building tower sector phase area village district state city january february march "
        "april may june july august september october november december designation address contact person telephone tel email website fax registered office corporate "
        "details name date birth dob din pan cin father mother husband wife son daughter key management auditor legal counsel account public committee audit general meeting"
    )
    #: Surnames that are an article too, and words that stand close behind it, in lower case, where it is one.
    article_surnames: frozenset[str] = _set("das")
    article_company: frozenset[str] = _set("der und ist dem nicht ein eine zu auf von mit")
    #: What a person's name follows, in lower case; each may end in a colon or a dash.
    person_labels: tuple[str, ...] = (
        "name", "full name", "applicant", "nominee", "signatory", "contact person", "contact name", "company secretary", "company secretary and compliance officer",
        "compliance officer", "father", "father's name", "father name", "mother's name", "husband's name", "husband name", "spouse's name", "guardian's name",
        "s/o", "d/o", "w/o", "c/o", "son of", "daughter of", "wife of", "care of",
    )
    #: What comes before a relative's name at the head of an address.
    relations: tuple[str, ...] = ("s/o", "d/o", "w/o", "c/o", "h/o", "son of", "daughter of", "wife of", "husband of", "care of")
    #: Legal forms that close an organisation's name, and forms that count with a capital only.
    legal_forms: tuple[str, ...] = (
        "limited", "ltd", "private limited", "private ltd", "pvt ltd", "pvt limited", "public limited", "pte ltd", "pte limited", "limited liability partnership",
        "llp", "l.l.p", "llc", "l.l.c", "plc", "gmbh", "inc", "incorporated", "corp", "corporation",
    )
    partner_forms: tuple[str, ...] = ("& co", "& company", "& associates", "& partners", "& sons", "and associates", "and company", "and co", "and sons")
    #: Forms that a full stop belongs to.
    short_forms: frozenset[str] = _set("ltd llp l.l.p inc corp co llc l.l.c")
    #: Capitalised words before an organisation's name that are no part of it.
    org_lead: frozenset[str] = _set(
        "a an the this that these our its his her their my your all both each every by for from in into of on to with within under over per via and or but as at is are was were be been has had "
        "when where while since after before between among against about including such m/s messrs mr mrs ms dr dear regarding re attn attention "
        "client customer vendor supplier contractor employer employee borrower lender seller buyer tenant landlord issuer issue offer promoter promoters company companies firm group manager managers lead "
        "director directors chairman partner partners auditor auditors banker bankers counsel advisor advisors registrar trustee sponsor shareholder shareholders member members subsidiary "
        "name address registered corporate head branch office contact details to"
    )
    #: Words that speak for an address; regions that may follow a PIN code; short forms whose full stop ends no sentence.
    address_cues: frozenset[str] = _set(
        "road street lane avenue marg path gali galli bazar bazaar chowk circle square crossing highway bypass expressway bridge gate flyover "
        "nagar puram pura colony society enclave vihar layout township village taluka tehsil mandal district dist sector phase block ward cross main extension area estate park garden gardens "
        "house flat floor plot door room shop unit wing building bldg tower towers apartment apartments residency villa bungalow complex plaza mall mansion chambers arcade godown shed "
        "industrial midc gidc survey khasra gat near opposite opp behind beside adjacent post po "
        "north south east west pune mumbai delhi bengaluru bangalore chennai kolkata hyderabad ahmedabad surat jaipur lucknow kanpur nagpur indore thane bhopal nashik vadodara noida gurugram kochi india"
    )
    regions: tuple[str, ...] = (
        "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala",
        "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura",
        "uttar pradesh", "uttarakhand", "west bengal", "delhi", "new delhi", "chandigarh", "puducherry", "ladakh", "jammu and kashmir", "lakshadweep",
    )
    address_short: frozenset[str] = _set("apt bldg blk cir col dist div dept est ext flr fl hno sno rly stn hwy ind jn ltd marg near nos opp pvt sec soc st tal teh twr vill")
    #: Words before a house's number, however long it is; "no" and its like also stand after them, and what makes a number after "no" a PIN code.
    house_words: frozenset[str] = _set("flat plot door room shop unit apt survey khasra gat hno h.no sno s.no")
    number_words: frozenset[str] = _set("no nos number")
    pin_words: frozenset[str] = _set("pin pincode code zip zipcode postal postcode")
    #: What, with a comma, closes an organisation's name before an address.
    before_address: frozenset[str] = _set("limited ltd llp bank")
    #: Words that stay as they are inside an organisation's pseudonym.
    generic_org: frozenset[str] = _set(
        "international india indian industries holdings group securities capital finance financial services management advisors consultants bank banking investments global "
        "technologies solutions systems engineering infrastructure projects trading exports manufacturing power energy steel chemicals pharma foods products logistics realty textiles "
        "private public limited ltd ltd. pvt pvt. llp inc inc. corporation corp corp. company co co. associates partners and & of the trust ventures insurance general labs data media plc gmbh llc"
    )
    common_names: frozenset[str] = _set("will mark grace hope rose bill frank june april august summer dawn jack joy may art dean lily miles rich rob star victor")
    mail_providers: frozenset[str] = _set("gmail.com yahoo.com outlook.com hotmail.com icloud.com protonmail.com aol.com live.com")
    #: Labels that stand before a country's domain.
    second_level: frozenset[str] = _set("co com org net ac edu gov gen firm ind nic res or ne go")
    role_mailboxes: frozenset[str] = _set("info contact support admin sales hr legal office mail careers enquiries help compliance investors grievance cs ir")
    fake_given: tuple[str, ...] = tuple("Ada Ben Cora Dan Edith Finn Gina Hal Ines Joel Kara Liam Mona Ned Opal Perry Quinn Ruth Sam Tess Una Vic Wade Xena Yuri Zora Abel Beth Cleo Drew".split())
    fake_surnames: tuple[str, ...] = tuple("Alder Birch Cedar Dale Elm Fern Grove Heath Ivers Jarrow Kelp Linden Marsh Nettle Oakes Pine Quarry Reed Sedge Thorn Upton Vale Willow Yarrow Ashby Brook Cliff Downs Ember Field".split())
    fake_brands: tuple[str, ...] = tuple("Arcadia Borealis Cascade Drumlin Elysia Fathom Glimmer Horizon Islet Juno Karst Lantern Mistral Nectar Obelisk Pelican Quill Ripple Solstice Tundra Umber Verve Wander Xylo Yonder Zodiac".split())
    fake_cities: tuple[str, ...] = tuple("Northmere Eastbrook Southwold Westhaven Lakeford Millgate Stonebury Fairmoor".split())
    fake_streets: tuple[str, ...] = ("Elder Road", "Mill Lane", "Harbour Street", "Garden Walk", "Station Avenue", "Canal Side")
    fake_buildings: tuple[str, ...] = ("Juniper House", "Quay Court", "Larch Plaza", "Beacon Tower", "Orchard Hall")


VOCABULARY = Vocabulary()
HONORIFICS = ("Mr", "Mrs", "Ms", "Mx", "Miss", "Master", "Dr", "Prof", "Professor", "Sir", "Shri", "Shrimati", "Sri", "Smt", "Kum", "Kumari", "Late", "Adv", "Advocate", "CA", "CS", "Capt", "Col", "Maj", "Justice", "Rev")
